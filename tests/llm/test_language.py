import numpy as np

from bidloom.llm.language import fit, grams, language_code, languages, letters, posteriors, sentences, train

TEXT = {
    "en": "the board will decide on the offers next week and publish the result for every part of the contract",
    "de": "der ausschuss wird in der nächsten woche über die angebote entscheiden und das ergebnis für jeden teil veröffentlichen",
    "fr": "la commission se prononcera sur les offres la semaine prochaine et publiera le résultat pour chaque partie du marché",
    "es": "la mesa decidirá sobre las ofertas la semana que viene y publicará el resultado de cada parte del contrato",
    "pl": "komisja rozstrzygnie oferty w przyszłym tygodniu i ogłosi wynik dla każdej części zamówienia",
}


def corpus(n=40, wrong=5):
    rows, rng = [], np.random.default_rng(1)
    for k, (code, text) in enumerate(TEXT.items()):
        w = text.split()
        for i in range(n):
            s = [" ".join(rng.permutation(w)[: 12]).capitalize() + "." for _ in range(4)]
            rows.append((k * 1000 + i, " ".join(s), "en" if i < wrong else {"en": "English", "de": "de-DE", "fr": "fre"}.get(code, code)))
    return rows


def test_labels_and_sentences():
    assert [language_code(x) for x in ("en-GB", "fr_FR", "Deutsch", " SPA ", "polski", "xx", "und", "", None)] == ["en", "fr", "de", "es", "pl", None, None, None, None]
    assert sentences("El contrato con X S.A. es nuevo. Foo & Co. KG went.\nTitle\n\nNext line\ncontinues here. End") == ["El contrato con X S.A. es nuevo.", "Foo & Co. KG went.", "Title", "Next line\ncontinues here.", "End"]
    assert letters("Ref. 2017/123 - CPV 71613000") == ""


def test_grams_are_the_distinct_substrings():
    ids, starts = grams(["abab", "", "ab"])
    assert starts[1] == starts[2] and starts[-1] == len(ids)
    padded = " abab "
    assert starts[1] <= len({padded[i : i + n] for n in (1, 2, 3, 4) for i in range(len(padded) - n + 1)})


def test_held_out_accuracy():
    rng = np.random.default_rng(9)
    texts, labels = zip(*[(letters(t), language_code(l)) for _, t, l in corpus()])
    model = fit(list(texts), list(labels))
    held = [(code, letters(" ".join(rng.permutation(t.split())[:9]))) for code, t in TEXT.items() for _ in range(50)]
    scores, _ = model.scores([x for _, x in held])
    right = np.mean([model.languages[k] == code for (code, _), k in zip(held, scores.argmax(axis=1))])
    assert right >= 0.98


def test_confidence_is_calibrated_on_held_out_sentences():
    """Short pieces that two languages share: the mean probability of the best guess is near its accuracy."""
    rng = np.random.default_rng(4)
    rows = [(code, letters(" ".join(rng.permutation(t.split())[:n]))) for code, t in TEXT.items() for n in (3, 4, 6, 9) for _ in range(80)]
    rng.shuffle(rows)
    rows = [(c, t) for c, t in rows if len(t) >= 20]
    half = len(rows) // 2
    model = fit([t for _, t in rows[:half]], [c for c, _ in rows[:half]])
    scores, sizes = model.scores([t for _, t in rows[half:]])
    p = np.exp(posteriors(scores, sizes, model.sharpness * model.temperature))
    right = np.mean([model.languages[k] == c for (c, _), k in zip(rows[half:], scores.argmax(axis=1))])
    assert model.temperature != 1.0 and abs(p.max(axis=1).mean() - right) < 0.05


def test_documents_and_segments(spark):
    rows = corpus() + [(9000, TEXT["de"].capitalize() + ". " + TEXT["fr"].capitalize() + ". " + TEXT["de"].capitalize() + ". " + TEXT["de"].capitalize() + ".", "de"), (9001, None, "de"), (9002, "", None), (9003, "12345 / 99", "fr"), (9004, (TEXT["es"].capitalize() + ". ") * 3000, "und"), (9005, TEXT["pl"], "en"), (9005, TEXT["pl"], "en")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, seg_no int")
    out = languages(df, train(df)).collect()
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    assert [(r.seg_no, r.lang_found) for r in sorted(by[9000], key=lambda r: r.seg_no)] == [(0, "de"), (1, "de"), (2, "fr"), (3, "de")]
    assert all(by[k][0].lang_found is None and by[k][0].confidence == 0 for k in (9001, 9002, 9003))
    assert by[9004][0].lang_found == "es" and not by[9004][0].label_ok
    assert len(by[9005]) == 2 and by[9005][0].lang_found == "pl" and not by[9005][0].label_ok
    wrong = [r for k in range(5) for i in range(40) for r in by[k * 1000 + i] if r.seg_no == 0 and r.lang_found != list(TEXT)[k]]
    assert len(wrong) <= 2
    assert all(0 <= r.confidence <= 1 for r in out)
    assert languages(df.limit(0), train(df.limit(0))).count() == 0
