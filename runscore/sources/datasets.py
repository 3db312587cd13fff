"""CSV datasets under analysis."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: texts read as missing, as pandas does by default ---------
NULL_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
# ----------------------------------------------------------------------------


@dataclass(frozen=True)
class DatasetSpec:
    """How one CSV is laid out and cleaned.

    ``columns`` names the columns of a file without a header. ``numbers`` maps
    columns to the type they are coerced to, bad text becoming null.
    """

    separator: str = ","
    columns: tuple[str, ...] = ()
    trim: bool = False
    numbers: dict[str, str] = field(default_factory=dict)
    renames: dict[str, str] = field(default_factory=dict)
    min_rows: int = 0


def clean_dataset(raw: DataFrame, spec: DatasetSpec) -> DataFrame:
    """Missing texts to null, empty and keyless rows off, numbers coerced, renames."""
    texts = [name for name, kind in raw.dtypes if kind == "string"]
    # a key of spaces only is blank, not missing: test it before trimming to null
    first = raw.columns[0]
    table = raw.withColumns({c: F.when(~F.col(c).isin(NULL_TEXTS), F.col(c)) for c in texts})
    table = table.na.drop("all")
    if first in texts:
        table = table.where(~F.coalesce(F.col(first).rlike(r"^\s*$"), F.lit(False)))
    table = table.withColumns(
        {c: F.trim(F.col(c).cast("string")).try_cast(kind) for c, kind in spec.numbers.items()}
    )
    return table.withColumnsRenamed(spec.renames)


def read_dataset(spark: SparkSession, path: str, spec: DatasetSpec = DatasetSpec()) -> DataFrame:
    """All columns as text unless coerced; fails below the row floor (then an action)."""
    reader = (
        spark.read.option("sep", spec.separator)
        .option("header", not spec.columns)
        .option("ignoreLeadingWhiteSpace", spec.trim)
        .option("nullValue", "")
        .option("multiLine", False)
    )
    if spec.columns:
        reader = reader.schema(", ".join(f"`{c}` string" for c in spec.columns))
    table = clean_dataset(reader.csv(path), spec)
    if spec.min_rows:
        require_rows(table, spec.min_rows)
    return table


def require_rows(table: DataFrame, floor: int) -> None:
    """Raise unless the table has at least ``floor`` rows (action, stops at the floor)."""
    found = table.limit(floor).count()
    if found < floor:
        raise ValueError(f"only {found} rows, need at least {floor}")
