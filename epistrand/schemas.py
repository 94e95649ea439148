"""Explicit schemas of the raw inputs, and the fixed values shared by operators."""

from pyspark.sql.types import (
    DateType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)


def _table(**columns):
    return StructType([StructField(name, kind, True) for name, kind in columns.items()])


VISIT_DX = _table(PATIENT_ID=StringType(), Shifted_date=DateType(), DX=StringType(), AIM_GROUP=StringType())
LABS = _table(PATIENT_ID=StringType(), Shifted_date=DateType(), LAB_NAME=StringType(), RESULT=StringType())
VITALS = _table(PATIENT_ID=StringType(), Shifted_date=DateType(), VITAL_CODE=StringType(), MEASUREMENT=StringType())
DEMOGRAPHICS = _table(PATIENT_ID=StringType(), AGE_AT_END=IntegerType())
EARLIEST_DX = _table(PATIENT_ID=StringType(), DX=StringType(), EARLIEST_DX=DateType())
LAB_CROSSWALK = _table(SUNQUEST_NAME=StringType(), LOINC_CODE=StringType())
EVENTS = _table(PATIENT_ID=StringType(), DATE=DateType(), CODE=StringType())
STEP_LOG = _table(
    epoch=IntegerType(), cnt=IntegerType(), global_step=LongType(),
    loss=DoubleType(), precision=DoubleType(), time=DoubleType(),
)

# Token names of the sequence vocabulary, in id order 0..4.
PAD, UNK, CLS, SEP, MASK = "PAD", "UNK", "CLS", "SEP", "MASK"
SPECIAL_TOKENS = [PAD, UNK, CLS, SEP, MASK]

# Label of each study group; any other group has no label.
LABEL_OF_GROUP = {"1_NoD": 0, "2_Type2": 1}

# Prediction horizons in years.
HORIZON_YEARS = [5, 3, 2, 1]

# Bin edges per laboratory test and vital sign. A value equal to
# an edge belongs to the bin above it.
BIN_EDGES = {
    "ALT(SGPT)": [10, 49, 98, 245, 735],
    "AST(SGOT)": [10, 34, 68, 170, 510],
    "BUN": [6, 20, 50, 100, 250],
    "CHOLESTEROL": [200, 240],
    "HDL": [45, 80, 100],
    "HGB A1C": [5.7, 6.5],
    "POTASSIUM": [3.5, 5.1, 6.5],
    "TRIGLYCERIDE": [150, 200, 500],
    "VITAL_10541041_MEAN": [18.5, 25, 30, 35, 40],
    "VITAL_10541455_MEAN": [36.1, 37.3, 38.1, 39.1, 41.1],
    "VITAL_10541467_MEAN": [60, 100],
    "VITAL_10541503_MEAN": [12, 20],
    "VITAL_266705352_MEAN": [90, 92, 94, 97, 100],
    "VITAL_283305634_MEAN": [97.0, 99.1, 100.6, 102.4, 105.8],
    "VITAL_68924855_MEAN": [120, 130, 140, 180],
    "LDL-POCT": [100, 130, 160, 190],
    "VITAL_10541029_MEAN": [120, 130, 140, 181],
    "VITAL_34506073_MEAN": [12, 21, 31],
    "VITAL_68924858_MEAN": [89, 90, 95],
    "ALB CONC": [3.5, 5.1],
    "FERRITIN": [20, 250],
    "INR": [0.8, 1.2, 2.0, 3.1],
    "PROTHROMBIN TIME": [11.0, 13.6],
    "UR CREATININE": [20, 321],
    "UR TOTAL PROTEIN": [150, 3000],
    "m_Bilirubin.direct": [0.3],
    "VITAL_10155324_MEAN": [1, 4, 7],
    "VITAL_10155611_MEAN": [1, 24, 32, 46],
    "VITAL_10155613_MEAN": [22, 36, 61],
    "VITAL_10541434_MEAN": [32, 51],
    "VITAL_10541511_MEAN": [60, 101, 131],
    "VITAL_10541524_MEAN": [36.1, 37.3, 38.0],
    "VITAL_10541596_MEAN": [9, 13],
    "VITAL_14049161_MEAN": [40, 50, 100],
}
