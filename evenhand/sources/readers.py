"""German credit, Statlog heart and Adult, from files in their published layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GERMAN = (
    "status string, month int, credit_history string, purpose string, credit_amount int, savings string, employment string, "
    "investment_as_income_percentage int, personal_status string, other_debtors string, residence_since int, property string, age int, "
    "installment_plans string, housing string, number_of_credits int, skill_level string, people_liable_for int, telephone string, foreign_worker string, credit int"
)
HEART = (
    "age double, sex double, chest_pain_type double, resting_blood_pressure double, serum_cholesterol double, fasting_blood_sugar double, resting_ecg double, "
    "max_heart_rate double, exercise_induced_angina double, oldpeak double, slope double, num_major_vessels double, thal double, heart_disease int"
)


def decode_sex(status: str = "personal_status") -> F.Column:
    """1 for the codes of men, else 0."""
    return F.when(F.col(status).isin("A91", "A93", "A94"), 1).otherwise(0)


def read_german(spark: SparkSession, path: str, target: str = "credit") -> DataFrame:
    """``sex`` from personal_status (dropped), target 1 for good and 0 for bad."""
    df = spark.read.csv(path, sep=" ", schema=GERMAN).withColumn("sex", decode_sex()).drop("personal_status")
    return _target(df, target, F.when(F.col(target) == 1, 1).when(F.col(target) == 2, 0) if target == "credit" else None)


def read_heart(spark: SparkSession, path: str, target: str = "heart_disease") -> DataFrame:
    df = spark.read.csv(path, sep=" ", schema=HEART)
    return _target(df, target, F.when(F.col(target) == 1, 1).when(F.col(target) == 2, 0) if target == "heart_disease" else None)


def read_adult(spark: SparkSession, path: str, target: str = "Probability") -> DataFrame:
    """Values keep the file's leading blanks; native-country and fnlwgt are dropped."""
    df = spark.read.csv(path, header=True, inferSchema=True, ignoreLeadingWhiteSpace=False)
    df = df.withColumn("sex", (F.col("sex") == " Male").cast("int")).withColumn("race", (F.col("race") == " White").cast("int"))
    return _target(df.drop("native-country", "fnlwgt"), target, (F.col(target) == " >50K").cast("int") if target in df.columns else None)


def split_target(df: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    """(features, target) as two frames of the same rows; both keep the order of the rows in their source."""
    if target not in df.columns:
        raise ValueError(f"no column {target}")
    return df.drop(target), df.select(target)


def _target(df: DataFrame, name: str, value: F.Column | None) -> DataFrame:
    if name not in df.columns:
        raise ValueError(f"no column {name}")
    return df if value is None else df.withColumn(name, value)
