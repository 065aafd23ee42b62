"""Call tables of third-party detectors and plain id lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.projections import file_name

# Labels of imported calls.
NO_CLASS = "Not Bat"


def read_tsv(spark: SparkSession, path) -> DataFrame:
    """Tab-separated text with a header; all columns stay text until they are cast."""
    return spark.read.option("sep", "\t").option("header", True).option("recursiveFileLookup", True).csv(path)


def read_calls_ms(spark: SparkSession, path: str, feature_columns: Sequence[str] | None = None) -> DataFrame:
    """Calls with times in ms and frequencies in kHz; the recording is the file's own name.

    Columns after the sixth are features unless named.
    """
    raw = read_tsv(spark, path)
    features = list(feature_columns) if feature_columns is not None else raw.columns[6:]
    d = lambda c: F.col(c).cast("double")
    stem = F.regexp_replace(file_name(F.col("_metadata.file_path")), r"\.ta$", ".wav")
    return raw.select(
        F.url_decode(stem).alias("recording"),
        F.lit(NO_CLASS).alias("class"),
        F.round(d("StTime") / 1000, 5).alias("start_time"),
        F.round((d("StTime") + d("Dur")) / 1000, 5).alias("end_time"),
        F.round(d("Fmin") * 1000, 2).alias("low_freq"),
        F.round(d("Fmax") * 1000, 2).alias("high_freq"),
        F.lit(0.0).alias("det_prob"),
        F.array(*[d(c) for c in features]).cast("array<double>").alias("features"),
    )


def species_codes(class_names: Sequence[str]) -> dict[str, str]:
    """First three letters of both words → name; ``x`` means none."""
    codes = {n.split(" ")[0][:3] + n.split(" ")[1][:3]: n for n in class_names}
    return {**codes, "x": "", "Bat": "Bat"}


def file_species(files: DataFrame, class_names: Sequence[str], only_accepted: bool = True) -> DataFrame:
    """Species per file: the accepted code, else (when allowed) the best guess.

    ``files``: Filename, accepted, accepted_prob, guess, guess_prob (text).
    Unknown codes fail, as a wrong class list would go unnoticed otherwise.
    """
    codes = F.create_map(*[F.lit(x) for kv in species_codes(class_names).items() for x in kv])
    use_first = F.lit(True) if only_accepted else F.col("accepted") != "x"
    code = F.when(use_first, F.col("accepted")).otherwise(F.col("guess"))
    prob = F.when(use_first, F.col("accepted_prob")).otherwise(F.col("guess_prob"))
    missing = F.raise_error(F.concat(F.lit("Unknown species code: "), code)).cast("string")
    return files.select(
        "Filename",
        F.coalesce(F.element_at(codes, code), missing).alias("class_name"),
        F.when(prob == "x", F.lit(0.0)).otherwise(prob.cast("double")).alias("class_prob"),
    )


def calls_with_species(calls: DataFrame, species: DataFrame, set_class: str | None = None) -> DataFrame:
    """Call rows (ms, kHz, quality) with the species of their file."""
    d = lambda c: F.col(c).cast("double")
    start = F.round(d("TimeInFile") / 1000, 5)
    label = F.col("class_name") if set_class is None else F.lit(set_class)
    extra = [c for c in calls.columns if c not in ("Filename", "TimeInFile", "CallDuration", "LowFreq", "HiFreq", "Quality")]
    return calls.join(species, "Filename").select(
        F.col("Filename").alias("recording"), label.alias("class"), "class_prob",
        start.alias("start_time"),
        F.round(start + d("CallDuration") / 1000, 5).alias("end_time"),
        F.round(d("LowFreq") * 1000, 2).alias("low_freq"),
        F.round(d("HiFreq") * 1000, 2).alias("high_freq"),
        F.round(d("Quality"), 3).alias("det_prob"),
        *extra,
    )


def read_file_species(spark: SparkSession, path: str, class_names: Sequence[str], only_accepted: bool = True) -> DataFrame:
    """The file-level table, by column place: name 2nd, accepted 5th/6th, best guess 9th/10th."""
    raw = read_tsv(spark, path)
    c = raw.columns
    pick = {"Filename": 1, "accepted": 4, "accepted_prob": 5, "guess": 8, "guess_prob": 9}
    return file_species(
        raw.select(*[F.trim(F.col(f"`{c[i]}`")).alias(n) for n, i in pick.items()]), class_names, only_accepted
    )


# --- lists -----------------------------------------------------------------

def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("value")).where(F.length("value") > 0)


def read_list(spark: SparkSession, path: str, format: str = "json", field: str | None = None, column: str | None = None) -> DataFrame:
    """Values of an id or path list as one ``value`` column.

    ``json``: a list, or an object with the list under ``field``. ``txt``: one
    value per line. ``csv``: the named column. Blanks are skipped; a missing
    field or column, or a document of the wrong shape, fails.
    """
    if format == "txt":
        return _lines(spark, path)
    if format == "csv":
        raw = spark.read.option("header", True).csv(path)
        if column is None or column not in raw.columns:
            raise ValueError(f"{path} has no column {column!r}")
        value = F.trim(F.col(f"`{column}`"))
        return raw.select(value.alias("value")).where(F.length("value") > 0)
    if format != "json":
        raise ValueError(f"Unknown list format {format}")
    text = spark.read.option("wholetext", True).text(path)
    if field is not None:
        values = F.get_json_object("value", f"$.{field}")
        shapes = text.select(
            F.col("_metadata.file_path").alias("file"), (F.left(F.ltrim("value"), F.lit(1)) == "{").alias("object"),
            values.isNotNull().alias("has"),
        )
        wrong = shapes.where(~F.col("object") | ~F.col("has")).orderBy("object", "file").first()  # any file of the folder
        if wrong and not wrong["object"]:
            raise TypeError(f"{wrong['file']} holds no JSON object")
        if wrong:
            raise KeyError(f"{wrong['file']} has no list under '{field}'")
        text = text.select(values.alias("value"))
    checked = F.when(
        F.left(F.ltrim("value"), F.lit(1)) == "[", F.from_json("value", "array<string>")
    ).otherwise(F.raise_error(F.lit("a list document must be a JSON array")).cast("array<string>"))
    return text.select(F.posexplode(checked).alias("position", "value")).select("value", "position")
