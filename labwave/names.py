"""Canonical column names of the clinical lab-series model.

Fixed values: these names must equal the source tables' column names so that
a user's existing tables and exports line up column for column.
"""

# --- fixed values: source column names -------------------------------------
PATIENT = "NOPHO_NR"
SAMPLE_TIME = "PL_DATETIME"
CODE = "IUPAC_CODE"
VALUE = "PL_Value"
MEASURE = "PL_Type"
REFTEXT = "REFTEXT"
INFNO = "INFNO"
INF_DATE = "MTX_INFDATE"
INF_TIME = "MTX_INF_START"
INF_START = "INF_START_DATETIME"
HOURS = "HOUR_DIFF_SAMPLE_INF"
SEX = "SEX"
STOP = "MP6_POST_STOP"
DETECTION = "detection"
PHENOTYPE = "PHONOTYPE"
PL_DATE = "PL_DATE"
PL_TIME = "PL_TIME"
CREA_MEASURE = "PL_PC"
MTX_MEASURE = "PL_MTX"
# --- end fixed values -------------------------------------------------------

# Our own: a unique sample id that makes every ordering total.
SAMPLE_ID = "SAMPLE_ID"
