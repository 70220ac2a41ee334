"""Affinity tables, score tables and cluster files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip
from ..operators.running import running
from ..store import keep

#: Kinds of measurement, and signs of a match.
TYPES = {"Kd": "KD", "Ki": "KI", "IC50": "IC50", "score": "SCORE"}
MATCHES = ("=", ">", "<", "~")
#: Below this a temperature is in Celsius.
CELSIUS_BELOW, ZERO_CELSIUS = 200.0, 273.15
AFFINITY = ("accession", "affinity_value", "affinity_type", "affinity_match", "structure_format", "year")


def lines(spark: SparkSession, path: str, anywhere: bool = True) -> DataFrame:
    """Lines of a text file without comments and, after that, without empty lines.

    `anywhere`: `#` starts a comment wherever it stands, else only at the start.
    """
    text = spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("value"))
    text = text.select(F.regexp_replace("value", "#.*$", "").alias("value")) if anywhere else text.where(~F.startswith("value", F.lit("#")))
    return text.where(F.col("value").rlike(r"\S"))


def split_csv(c: Column) -> Column:
    """Fields of a line; commas within double quotes do not split, quotes are dropped."""
    checked = F.when(F.length(F.regexp_replace(c, '[^"]', "")) % 2 == 0, c).otherwise(F.raise_error(F.concat(F.lit("unbalanced quotes: "), c)))
    return F.transform(F.split(checked, ',(?=(?:[^"]*"[^"]*")*[^"]*$)'), lambda x: strip(F.regexp_replace(x, '"', "")))


def required(value: Column, what: str, raw: Column) -> Column:
    """`value`, or an error that names the text it could not be read from."""
    return F.coalesce(value, F.raise_error(F.concat(F.lit(f"bad {what}: "), F.coalesce(raw, F.lit("nothing")))).cast("string"))


def read_affinity(spark: SparkSession, path: str) -> DataFrame:
    """Measurements by header name, decoded. Lines without a comma are passed over; a
    line of another width than the header, or a value that can't be read, fails.

    A header is a line that names all needed columns. `path` may hold many files, each
    with the header or without: they are one table, and two different headers fail."""
    rows = lines(spark, path).where(F.contains("value", F.lit(","))).select(split_csv(F.col("value")).alias("f"))
    named = F.size(F.array_intersect("f", F.array(*map(F.lit, AFFINITY)))) == len(AFFINITY)
    found = rows.where(named).select("f").distinct().limit(2).collect()
    if len(found) > 1:
        raise ValueError("files with different headers")
    if not found:
        first = rows.first()
        missing = [c for c in AFFINITY if not first or c not in first["f"]]
        raise ValueError(f"no column {missing[0]}")
    header = found[0]["f"]
    width = F.size("f") == len(header)
    body = rows.where(F.col("f") != F.array(*map(F.lit, header)))
    body = body.select(F.when(width, F.col("f")).otherwise(F.raise_error(F.concat(F.lit("line of another width: "), F.array_join("f", ","))).cast("array<string>")).alias("f"))
    named = body.select(*[F.col("f")[i].alias(c) for i, c in enumerate(header)])
    for c in ("structure_pH", "structure_Temperature"):
        if c not in header:
            named = named.withColumn(c, F.lit(None).cast("string"))
    return decode_affinity(named)


def decode_affinity(rows: DataFrame) -> DataFrame:
    """Typed measurements: accession, value (natural logarithm, but scores as they
    are), affinity_type, affinity_match, structure_type, resolution, year, ph,
    temperature (kelvin). Absent numbers are null."""
    kind = F.create_map(*[F.lit(v) for kv in TYPES.items() for v in kv])[F.col("affinity_type")]
    value = F.expr("try_cast(affinity_value as double)")
    form, temperature = F.col("structure_format"), F.expr("try_cast(structure_Temperature as double)")
    resolution = F.regexp_extract(form, r"^X-RAY=([0-9.]+)$", 1)
    structure = F.when(resolution != "", "XRAY").when(form == "NMR", "NMR")
    typed = rows.select(
        "accession",
        required(kind, "affinity type", F.col("affinity_type")).alias("affinity_type"),
        required(F.when(F.col("affinity_match").isin(*MATCHES), F.col("affinity_match")), "match", F.col("affinity_match")).alias("affinity_match"),
        required(value.cast("string"), "value", F.col("affinity_value")).cast("double").alias("value"),
        required(structure, "structure format", form).alias("structure_type"),
        F.expr("try_cast(nullif(regexp_extract(structure_format, '^X-RAY=([0-9.]+)$', 1), '') as double)").alias("resolution"),
        required(F.expr("try_cast(year as int)").cast("string"), "year", F.col("year")).cast("int").alias("year"),
        F.expr("try_cast(structure_pH as double)").alias("ph"),
        F.when(temperature < CELSIUS_BELOW, temperature + ZERO_CELSIUS).otherwise(temperature).alias("temperature"),
    )
    return typed.withColumn("value", log_value(F.col("value"), F.col("affinity_type")))


def log_value(value: Column, kind: Column) -> Column:
    """Natural logarithm of a concentration; scores stay. Not above zero fails."""
    bad = F.raise_error(F.concat(F.lit("not above zero: "), value.cast("string"))).cast("double")
    return F.when(kind == "SCORE", value).when(value > 0, F.ln(value)).otherwise(bad)


def unique(rows: DataFrame, key: str) -> DataFrame:
    """`rows`, failing where `key` occurs more than once."""
    n = rows.groupBy(key).agg(F.count("*").alias("n"))
    return rows.join(n, key).withColumn("n", F.when(F.col("n") == 1, 1).otherwise(F.raise_error(F.concat(F.lit("occurs twice: "), F.col(key))).cast("int"))).where("n = 1").drop("n")


def _scores(fields: DataFrame) -> DataFrame:
    """(complex_id, scores) of rows (id, f); all of one width, ids unique."""
    widths = fields.agg(F.min(F.size("f")).alias("a"), F.max(F.size("f")).alias("b")).first()
    if widths["a"] != widths["b"]:
        raise ValueError(f"lines of {widths['a']} and of {widths['b']} scores")
    return unique(fields.select(F.col("id").alias("complex_id"), F.transform("f", lambda x: x.cast("float")).alias("scores")), "complex_id")


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """`id,f1,...,fn` without a header, comments only at the start of a line."""
    rows = lines(spark, path, anywhere=False).select(F.transform(F.split("value", ","), strip).alias("a"))
    return _scores(rows.select(F.col("a")[0].alias("id"), F.slice("a", 2, F.size("a") - 1).alias("f")))


def read_score_report(spark: SparkSession, path: str) -> DataFrame:
    """Score lines separated by white space: `SCORE: f1 ... fn id_0001` below a
    `SEQUENCE:` line and a `SCORE:` header. The last column before the id counts too."""
    text = spark.read.text(path).select(F.split(strip(F.col("value")), r"\s+").alias("a"))
    rows = text.where((F.col("a")[0] == "SCORE:") & F.get("a", F.lit(1)).try_cast("float").isNotNull())
    return _scores(rows.select(F.regexp_extract(F.element_at("a", -1), r"^(.*?)(_[0-9]+)?$", 1).alias("id"), F.slice("a", 2, F.size("a") - 2).alias("f")))


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """(clustering_id, min_dist, cluster_id, complex_id) of lines `min_dist:(A,B)(C)`.

    A line without a distance has -1. Lines must hold the same ids, each once. Of several
    files, as many tasks write them, those of later names go on with the clusterings.
    """
    meta = F.col("_metadata")
    # Lines of a split are read in order, and splits of a file begin one after the other.
    at = F.struct(meta["file_name"].alias("file"), meta["file_block_start"].alias("start"), F.monotonically_increasing_id().alias("line"))
    text = spark.read.text(path).select(at.alias("at"), F.regexp_replace("value", "#.*$|\r$", "").alias("line"))
    return parse_clusters(keep(text.where(F.col("line").rlike(r"\S"))))


def parse_clusters(text: DataFrame) -> DataFrame:
    """As `read_clusters`, of rows (at, line)."""
    well = F.col("line").rlike(r"^\s*([-+0-9.eE]+\s*:)?\s*(\(\s*[^(),\s][^()]*\)\s*)+$")
    line = F.when(well, F.col("line")).otherwise(F.raise_error(F.concat(F.lit("not a clustering: "), F.col("line"))).cast("string"))
    rows = text.withColumn("line", line).withColumn("min_dist", F.coalesce(F.expr("try_cast(nullif(trim(regexp_extract(line, '^([^:(]*):', 1)), '') as double)"), F.lit(-1.0)))
    groups = rows.select("at", "min_dist", F.posexplode(F.regexp_extract_all("line", F.lit(r"\(([^)]*)\)"), F.lit(1))).alias("cluster_id", "members"))
    long = groups.select("at", "min_dist", "cluster_id", F.explode(F.split("members", r"\s*,\s*")).alias("complex_id")).withColumn("complex_id", strip(F.col("complex_id")))
    numbers = running(text.select("at", F.lit(0).alias("all")), ["all"], [F.col("at")], {"clustering_id": F.lit(1)})
    long = numbers.select("at", (F.col("clustering_id") - 1).cast("int").alias("clustering_id")).join(long, "at").select("clustering_id", "min_dist", "cluster_id", "complex_id")
    return checked_clusters(long)


def checked_clusters(long: DataFrame) -> DataFrame:
    """`long`, failing if an id is twice in a clustering or missing from one."""
    each = long.groupBy("complex_id").agg(F.count("*").alias("n"), F.countDistinct("clustering_id").alias("k"))
    total = long.agg(F.countDistinct("clustering_id").alias("n")).first()["n"]
    bad = each.where((F.col("n") != total) | (F.col("k") != total)).first()
    if bad:
        raise ValueError(f"{bad['complex_id']} is not once in each clustering")
    return long


def read_open_access(spark: SparkSession, path: str) -> DataFrame:
    """(accession, article) of lines `accession,article` below a header; blank lines are
    passed over, an accession that occurs twice fails."""
    rows = lines(spark, path).select(F.transform(F.split("value", ","), strip).alias("f"))
    header = rows.first()["f"]  # of one file
    pairs = rows.where(F.col("f") != F.array(*map(F.lit, header))).select(F.col("f")[0].alias("accession"), F.get("f", F.lit(1)).alias("article"))
    return unique(pairs.where("accession <> ''"), "accession")
