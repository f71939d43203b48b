"""A4/A7 request messages, B5-B9/B12 settings, validation and routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

from revkit.functions.paths import repo_info
from revkit.operators.context import NAMED_FILES
from revkit.operators.reviews import has_code_or_file_reference

SETTING = StructType(
    [
        StructField("label", StringType()),
        StructField("type", StringType()),
        StructField("description", StringType()),
        StructField("default", StringType()),
        StructField("value", StringType()),
        StructField("required", BooleanType()),
        StructField("options", ArrayType(StringType())),
    ]
)
MESSAGE = StructType(
    [
        StructField("channel_id", StringType()),
        StructField("message", StringType()),
        StructField("settings", ArrayType(SETTING)),
    ]
)
# Setting defaults of the integration.
DEFAULT_CODE_SOURCE = "github"
DEFAULT_THRESHOLD = 70.0
#: A number as a threshold may be written (no blanks, no type suffix).
NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"


def parse_messages(raw: DataFrame, text_col: str = "value") -> DataFrame:
    """A4: JSON text -> typed message columns; undecodable text keeps
    ``corrupt`` set (a 400 'Invalid request body' downstream)."""
    schema = StructType(MESSAGE.fields + [StructField("_corrupt", StringType())])
    parsed = F.from_json(F.col(text_col), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    keep = [c for c in raw.columns if c != text_col]
    out = raw.select(*keep, F.col(text_col), parsed.alias("m"))
    bad = F.col("m").isNull() | F.col("m._corrupt").isNotNull()
    return out.select(
        *keep, F.col(text_col).alias("raw"), F.col("m.channel_id").alias("channel_id"), F.col("m.message").alias("message"),
        F.col("m.settings").alias("settings"), bad.alias("corrupt"),
    )


def setting(settings: Column, label: str, field: str = "default") -> Column:
    """The last setting with this label (null when absent)."""
    return F.try_element_at(F.filter(settings, lambda s: s["label"] == label), F.lit(-1))[field]


def setting_text(settings: Column, label: str, field: str = "default") -> Column:
    """As ``setting``, but a setting that is there without the field is the empty text."""
    held = F.filter(settings, lambda s: s["label"] == label)
    return F.when(F.size(held) > 0, F.coalesce(F.try_element_at(held, F.lit(-1))[field], F.lit("")))


def resolve_settings(msgs: DataFrame, field: str = "default") -> DataFrame:
    """Per message the settings the analysis runs with."""
    s = F.col("settings")
    # every threshold that parses is assigned in turn: the last of them holds
    found = F.transform(F.filter(s, lambda x: x["label"] == "minimum_quality_threshold"), lambda x: x[field])
    parsed = F.filter(found, lambda x: F.coalesce(x.rlike(NUMBER), F.lit(False)))
    thr = F.try_element_at(parsed, F.lit(-1)).try_cast("double")
    aspects = setting_text(s, "analysis_aspects", field)
    inc = setting_text(s, "include_recommendations", field)
    return msgs.select(
        "*",
        F.coalesce(setting_text(s, "repository_url", field), F.lit("")).alias("repository_url"),
        F.coalesce(setting_text(s, "code_source", field), F.lit(DEFAULT_CODE_SOURCE)).alias("code_source"),
        F.coalesce(thr, F.lit(DEFAULT_THRESHOLD)).alias("threshold"),
        F.when(aspects.isNotNull(), F.split(aspects, ",", -1)).alias("aspects"),
        F.when(inc.isNotNull(), inc == "true").otherwise(F.lit(True)).alias("include_recommendations"),
    )


def has_named_reference(message: Column) -> Column:
    return F.exists(F.array(*[F.lit(n) for n, _a, _b in NAMED_FILES]), lambda n: F.contains(message, n))


def validate(msgs: DataFrame, field: str = "value", rate_limited: Column | None = None) -> DataFrame:
    """Status and message of each request, in the checking order of the
    request handler (rate limit, body, empty message, code source, URL, refs)."""
    s = F.col("settings")
    cs = F.coalesce(setting(s, "code_source", field), F.lit(""))
    url = F.coalesce(setting(s, "repository_url", field), F.lit(""))
    m = F.coalesce(F.col("message"), F.lit(""))
    gh_prefix = "https://github.com/"
    parts = F.split(F.substr(url, F.lit(len(gh_prefix) + 1)), "/", -1)
    limited = rate_limited if rate_limited is not None else F.lit(False)
    def st(code: int, msg) -> Column:
        return F.struct(F.lit(code).alias("http_status"), (msg if isinstance(msg, Column) else F.lit(msg)).cast("string").alias("error"))

    status = (
        F.when(limited, st(429, "Rate limit exceeded"))
        .when(F.col("corrupt"), st(400, F.lit("Invalid request body")))
        .when(m == "", st(400, F.lit("Empty message")))
        .when(cs == "", st(400, F.lit("Missing required setting: code_source")))
        .when((cs == "github") & (url == ""), st(400, F.lit("Repository URL is required for GitHub source")))
        .when((cs == "github") & ~url.startswith(gh_prefix), st(400, F.concat(F.lit("Invalid repository URL: "), url)))
        .when((cs == "github") & (F.size(parts) < 2), st(400, F.lit("Invalid repository URL format")))
        .when((cs == "github") & ~has_named_reference(m), st(400, F.lit("no code references found in comment")))
        .when(cs == "github", st(200, F.lit(None)))
        .when((cs == "direct") & ~has_code_or_file_reference(m), st(400, F.lit("No code references found in comment")))
        .when(cs == "direct", st(200, F.lit(None)))
        .otherwise(st(400, F.concat(F.lit("Unsupported code source: "), cs)))
    )
    return msgs.select("*", status.alias("st")).select("*", "st.http_status", "st.error").drop("st")


def split_valid(validated: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Valid requests, and rejects (their raw body, http_status, error).

    ``validated`` is evaluated once: one job writes both, as partitions of a
    table under ``path``; each reader opens its own partition only."""
    sink = F.when(F.col("http_status") == 200, "valid").otherwise("rejects")
    validated.withColumn("sink", sink).write.partitionBy("sink").parquet(path)
    schema = StructType([*validated.schema.fields, StructField("sink", StringType())])
    rows = validated.sparkSession.read.schema(schema).parquet(path)
    valid, rejects = rows.where("sink = 'valid'"), rows.where("sink = 'rejects'")
    return valid.drop("sink"), rejects.drop("sink", "settings", "corrupt")


def route(resolved: DataFrame) -> DataFrame:
    """Repository key for non-direct requests; direct ones skip files."""
    info = repo_info(F.col("repository_url"))
    return resolved.select(
        "*",
        F.when(F.col("code_source") != "direct", info["provider"]).alias("provider"),
        F.when(F.col("code_source") != "direct", info["owner"]).alias("owner"),
        F.when(F.col("code_source") != "direct", info["repo"]).alias("repo_name"),
        F.when(F.col("code_source") != "direct", info["error"]).alias("route_error"),
    )


def to_reply(df: DataFrame, message: Column) -> DataFrame:
    """The reply object as JSON text (event_name, message, status, username)."""
    return df.select(
        "*",
        F.to_json(
            F.struct(
                F.lit("Code Review Analysis").alias("event_name"),
                message.alias("message"),
                F.lit("success").alias("status"),
                F.lit("Code Review Analyzer").alias("username"),
            )
        ).alias("reply"),
    )
