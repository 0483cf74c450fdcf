"""The raw notice schemas (fixed values, in file order)."""

CAN_COLUMNS = (
    "ID_NOTICE_CAN TED_NOTICE_URL YEAR ID_TYPE DT_DISPATCH XSD_VERSION CANCELLED CORRECTIONS B_MULTIPLE_CAE CAE_NAME "
    "CAE_NATIONALID CAE_ADDRESS CAE_TOWN CAE_POSTAL_CODE CAE_GPA_ANNEX ISO_COUNTRY_CODE ISO_COUNTRY_CODE_GPA "
    "B_MULTIPLE_COUNTRY ISO_COUNTRY_CODE_ALL CAE_TYPE EU_INST_CODE MAIN_ACTIVITY B_ON_BEHALF "
    "B_INVOLVES_JOINT_PROCUREMENT B_AWARDED_BY_CENTRAL_BODY TYPE_OF_CONTRACT TAL_LOCATION_NUTS B_FRA_AGREEMENT "
    "FRA_ESTIMATED B_FRA_CONTRACT B_DYN_PURCH_SYST CPV MAIN_CPV_CODE_GPA ID_LOT ADDITIONAL_CPVS B_GPA GPA_COVERAGE "
    "LOTS_NUMBER VALUE_EURO VALUE_EURO_FIN_1 VALUE_EURO_FIN_2 B_EU_FUNDS TOP_TYPE B_ACCELERATED OUT_OF_DIRECTIVES "
    "CRIT_CODE CRIT_PRICE_WEIGHT CRIT_CRITERIA CRIT_WEIGHTS B_ELECTRONIC_AUCTION NUMBER_AWARDS ID_AWARD ID_LOT_AWARDED "
    "INFO_ON_NON_AWARD INFO_UNPUBLISHED B_AWARDED_TO_A_GROUP WIN_NAME WIN_NATIONALID WIN_ADDRESS WIN_TOWN "
    "WIN_POSTAL_CODE WIN_COUNTRY_CODE B_CONTRACTOR_SME CONTRACT_NUMBER TITLE NUMBER_OFFERS NUMBER_TENDERS_SME "
    "NUMBER_TENDERS_OTHER_EU NUMBER_TENDERS_NON_EU NUMBER_OFFERS_ELECTR AWARD_EST_VALUE_EURO AWARD_VALUE_EURO "
    "AWARD_VALUE_EURO_FIN_1 B_SUBCONTRACTED DT_AWARD"
).split()
