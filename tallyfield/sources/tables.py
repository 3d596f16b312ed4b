"""Table readers and writers, and the model store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyfield.sources.config import locked

#: Currencies known as cash, and the suffix of a ticker at an exchange.
CURRENCIES = ("AUD", "CAD", "CHF", "DKK", "EUR", "GBP", "HKD", "JPY", "NOK", "NZD", "SEK", "SGD", "USD")
EXCHANGE_SUFFIXES = (("GY", ".DE"), ("FP", ".PA"), ("IM", ".MI"), ("LN", ".L"), ("SW", ".SW"), ("US", ""), ("NA", ".AS"), ("SM", ".MC"))


def read_csv(spark: SparkSession, uri: str, schema: StructType | str, date_field: str | None = None, start: str | None = None, end: str | None = None, date_format: str = "yyyy-MM-dd") -> DataFrame:
    """A CSV file with a header; the date window is inclusive and reaches the scan."""
    df = spark.read.option("header", True).option("dateFormat", date_format).schema(schema).csv(uri)
    if date_field and start:
        df = df.where(F.col(date_field) >= F.lit(start).cast("date"))
    if date_field and end:
        df = df.where(F.col(date_field) <= F.lit(end).cast("date"))
    return df


def read_sheet(spark: SparkSession, path: str, sheet: int | str = 0, header_row: int = 0, data_row: int | None = None) -> DataFrame:
    """A spreadsheet, by the driver, with the header row named later. Needs an Excel engine of pandas."""
    import pandas as pd

    try:
        raw = pd.read_excel(path, sheet_name=sheet, header=None, dtype=str)
    except ImportError as missing:
        raise NotImplementedError("reading spreadsheets needs openpyxl or xlrd; save the sheet as CSV instead") from missing
    return promoted(spark, raw.values.tolist(), header_row, data_row)


def promoted(spark: SparkSession, rows: list[list], header_row: int, data_row: int | None = None) -> DataFrame:
    """Rows of strings with one of them as the header."""
    names = [str(x) for x in rows[header_row]]
    body = [[None if x is None or x != x else str(x) for x in r] for r in rows[data_row if data_row is not None else header_row + 1 :]]
    return spark.createDataFrame(body, ", ".join(f"`{n}` string" for n in names))


def missing_columns(df: DataFrame, expected: list[str]) -> list[str]:
    return sorted(set(expected) - set(df.columns))


def write_table(df: DataFrame, folder: str, name: str, form: str = "parquet", partition_by: list[str] | None = None) -> bool:
    """Write over a table unless the folder is locked; says whether it wrote."""
    if locked(df.sparkSession, folder):
        return False
    w = df.write.mode("overwrite").format(form)
    if form == "csv":
        w = w.option("header", True)
    (w.partitionBy(*partition_by) if partition_by else w).save(f"{folder.rstrip('/')}/{name}")
    return True


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}")


def save_model(folder: str, model: str, tables: dict[str, DataFrame]) -> None:
    """A fitted model as Parquet tables."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{model}/{name}")


def load_model(spark: SparkSession, folder: str, model: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder.rstrip('/')}/{model}/{n}") for n in names}


def ticker_of_file(column):
    """The ticker in a file name such as ``daily_AAA.csv``: what follows the last underscore."""
    return F.regexp_extract(column, r"_([^_/]+)\.[A-Za-z]+$", 1)


def risk_free(spark: SparkSession, rates: dict[str, float]) -> DataFrame:
    """(ccy, rate): a small dimension table."""
    return spark.createDataFrame(sorted(rates.items()), "ccy string, rate double")
