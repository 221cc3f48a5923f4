"""Feature views, cleaning and encoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .places import place, quantile_bucket

DOC_NUMERIC = ("letter_ratio", "punct_ratio", "digit_ratio", "n_words", "n_lines", "n_chars")


def _share(text: Column, keep: str, rare: bool = True) -> Column:
    """Share of the characters of a class; what is rare is counted, the class or the others."""
    size = F.length(text)
    kept = F.regexp_count(text, F.lit(f"[{keep}]")) if rare else size - F.regexp_count(text, F.lit(f"[^{keep}]"))
    return F.round(kept / F.greatest(size, F.lit(1)), 6)


def doc_features(spark: SparkSession, sf_dir: str, label: str = "quality") -> DataFrame:
    """Labelled documents: row_id, label, six numeric features and the language.

    Features are taken before labels are joined, so texts are scanned where they lie and never shuffled.
    """
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    text = F.col("text")
    shares = {"letter_ratio": _share(text, "a-zA-Z ", False), "punct_ratio": _share(text, ".!?"), "digit_ratio": _share(text, "0-9")}
    counts = {n: (F.length(text) - F.length(F.replace(text, F.lit(x), F.lit(""))) + 1) for x, n in ((" ", "n_words"), ("\n", "n_lines"))}
    columns = [v.alias(k) for k, v in shares.items()] + [v.cast("double").alias(k) for k, v in counts.items()]
    told = docs.select("doc_id", *columns, F.col("n_chars").cast("double").alias("n_chars"), "lang")
    named = labels.select("doc_id", F.col(label).cast("int").alias("label"))
    return told.join(named, "doc_id").select(F.col("doc_id").alias("row_id"), "label", *DOC_NUMERIC, "lang")


def positional(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """The table with its last column as `label` (a whole number), and the names of the others, its features."""
    *features, label = df.columns
    return df.select(*features, F.col(label).cast("int").alias("label")), features


def profile(df: DataFrame, label: str = "label") -> DataFrame:
    """label, n, share of every class, with the table's rows, its number of columns and their names."""
    n = df.groupBy(label).agg(F.count("*").alias("n"))
    whole = n.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"))
    said = (F.lit(len(df.columns)).alias("n_columns"), F.lit(", ".join(df.columns)).alias("columns"))
    share = F.round(F.col("n") / F.col("n_rows"), 9).alias("share")
    return n.crossJoin(F.broadcast(whole)).select(F.col(label).alias("label"), "n", share, "n_rows", *said)  # one row


def trim_all(df: DataFrame) -> DataFrame:
    """Strip white space on both sides of every string column."""
    return df.withColumns({c: F.regexp_replace(c, r"^\s+|\s+$", "") for c, t in df.dtypes if t == "string"})


def replace_cells(df: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """Cells of string columns that are exactly a key of pairs get its value, in the whole table."""
    return df.replace(pairs, subset=[c for c, t in df.dtypes if t == "string"])


def map_values(column: Column, pairs: dict, otherwise: Column | None = None) -> Column:
    out = F.lit(None)
    for k, v in pairs.items():
        out = F.when(column == k, F.lit(v)).otherwise(out)
    return F.coalesce(out, otherwise) if otherwise is not None else out


def map_target(column: Column, pairs: dict[str, int]) -> Column:
    """A label by its name; any other value, null too, fails the query."""
    said = F.concat(F.lit("label is not mapped: "), F.coalesce(column.cast("string"), F.lit("null")))
    return F.coalesce(map_values(column, pairs), F.raise_error(said).cast("int"))


#: Pairs of values that are encoded as 1 and 0.
BINARY = (("Yes", "No"), ("Male", "Female"))


def binary_encode(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns of nothing but Yes and No, or Male and Female (and nulls), as 1 and 0; others stay. One pass tells which."""
    if not columns:
        return df
    only = lambda c, pair: F.bool_and(F.col(c).isin(*pair))  # noqa: E731  null where a column holds nulls only
    told = df.agg(*(only(c, p).alias(f"{i}_{k}") for i, c in enumerate(columns) for k, p in enumerate(BINARY))).first()
    for i, c in enumerate(columns):
        for k, (one, zero) in enumerate(BINARY):
            if told[f"{i}_{k}"]:
                df = df.withColumn(c, map_values(F.col(c), {one: 1, zero: 0}))
                break
    return df


def factorize(df: DataFrame, column: str, row_id: str = "row_id") -> DataFrame:
    """Adds <column>_code: values numbered by first appearance, null -1."""
    first = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.min(row_id).alias("_first"))
    codes = place(quantile_bucket(first, "_first"), [], [F.col("_first"), F.col(column)], "_code").drop("_first", "_code_of")
    return df.join(codes, column, "left").withColumn(f"{column}_code", F.coalesce("_code", F.lit(-1))).drop("_code")


def to_number(column: str) -> Column:
    return F.coalesce(F.expr(f"try_cast({column} AS DOUBLE)"), F.lit(0.0))
