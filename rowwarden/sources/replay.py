"""Recorded proposals, read back and validated again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The proposal fields and their types; unknown fields are refused.
PROPOSAL_FIELDS = (
    "proposal_id", "fingerprint", "summary", "root_cause_hypothesis", "candidate_actions",
    "do_not_apply_reasons", "confidence",
)
ACTION_FIELDS = ("action_id", "evidence", "rationale")
EVIDENCE_FIELDS = ("check_id", "contract_id")
PROPOSAL_TYPE = (
    "struct<proposal_id:string,summary:string,root_cause_hypothesis:string,confidence:double,"
    "candidate_actions:array<struct<action_id:string,rationale:string,"
    "evidence:array<struct<check_id:string,contract_id:string>>>>,"
    "do_not_apply_reasons:array<string>>"
)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """JSONL trace files as (source, position, text). Block start and row order within a block
    give the line order of a file however it is split."""
    return (
        spark.read.text(path)
        .select(
            F.col("_metadata.file_path").alias("source"),
            F.struct(F.col("_metadata.file_block_start").alias("block"),
                     F.monotonically_increasing_id().alias("row")).alias("position"),
            F.col("value").alias("text"))
        .filter(F.trim("text") != "")
    )


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Single-document JSON files in the same shape."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("source"),
        F.struct(F.lit(0).cast("bigint").alias("block"), F.lit(0).cast("bigint").alias("row")).alias("position"),
        F.col("value").alias("text"))


def replay(lines: DataFrame) -> DataFrame:
    """(source, n_lines, proposal, problem): the last record of a source that has a proposal.

    A record is a proposal or an envelope around one. A source with a single record may hold
    the bare proposal; one unreadable line refuses its source.
    """
    staged = lines.select("source", "position", "text", F.try_parse_json("text").alias("record"))
    staged = staged.withColumn("held", F.try_variant_get("record", "$.proposal", "variant"))
    # only a record that holds something under the name is read again for its text
    inner = F.when(F.col("held").isNotNull(), F.get_json_object("text", "$.proposal"))
    marked = staged.withColumn("inner", inner).select(
        "source", "position", "text", F.col("record").isNotNull().alias("readable"),
        F.when(~F.col("inner").isin("", "{}", "[]", "0", "false"), F.col("inner")).alias("inner"))
    per_source = marked.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.bool_and("readable").alias("readable"),
        F.max_by("inner", F.when(F.col("inner").isNotNull(), F.col("position"))).alias("inner"),
        F.max_by("text", "position").alias("last"),
    )
    bare = (F.col("n_lines") == 1) & F.col("inner").isNull()
    problem = (
        F.when(~F.col("readable"), "a line is not JSON")
        .when(~bare & F.col("inner").isNull(), "no proposal envelope"))
    return per_source.select(
        "source", "n_lines",
        F.when(problem.isNull(), F.when(bare, F.col("last")).otherwise(F.col("inner"))).alias("proposal"),
        problem.alias("problem"))


def _strange_keys(value: Column, allowed: tuple[str, ...]) -> Column:
    """Does a variant object have other fields than these? What is no object has none."""
    fields = F.map_keys(F.try_variant_get(value, "$", "map<string,variant>"))
    return F.coalesce(F.size(F.array_except(fields, F.array(*[F.lit(k) for k in allowed]))) > 0, F.lit(False))


def parse_proposals(rows: DataFrame, text: str = "proposal") -> DataFrame:
    """Adds ``parsed`` (the proposal, null when refused), ``valid`` and ``violation``.

    Refused are unreadable JSON, unknown fields at any level, missing texts, a confidence outside
    [0, 1], an action without id, rationale or evidence, and evidence with an empty id. A text is
    parsed twice: into the typed proposal, and into a variant that knows all its fields.
    """
    raw = F.col(text)
    staged = rows.withColumn("__p", F.from_json(raw, PROPOSAL_TYPE)).withColumn("__v", F.try_parse_json(raw))
    odd_action = F.exists(
        F.try_variant_get("__v", "$.candidate_actions", "array<variant>"),
        lambda a: _strange_keys(a, ACTION_FIELDS) | F.coalesce(F.exists(
            F.try_variant_get(a, "$.evidence", "array<variant>"), lambda e: _strange_keys(e, EVIDENCE_FIELDS)), F.lit(False)))
    blank = lambda value: F.coalesce(value, F.lit("")) == ""
    bad_action = F.exists(F.col("__p")["candidate_actions"], lambda a: (
        blank(a["action_id"]) | blank(a["rationale"])
        | (F.coalesce(F.size(a["evidence"]), F.lit(0)) == 0)
        | F.exists(a["evidence"], lambda e: blank(e["check_id"]) | blank(e["contract_id"]))))
    p = F.col("__p")
    readable = F.col("__v").isNotNull()
    violation = (
        F.when(~F.coalesce(readable, F.lit(False)) | p.isNull(), "not a JSON object")
        .when(_strange_keys(F.col("__v"), PROPOSAL_FIELDS) | F.coalesce(odd_action, F.lit(False)), "unknown field")
        .when(p["summary"].isNull() | p["root_cause_hypothesis"].isNull(), "missing text")
        .when(~F.coalesce(p["confidence"].between(0.0, 1.0), F.lit(False)), "confidence outside [0, 1]")
        .when(F.coalesce(bad_action, F.lit(False)), "incomplete candidate action"))
    return staged.withColumn("violation", violation).withColumn(
        "valid", F.col("violation").isNull()).withColumn(
        "parsed", F.when(F.col("violation").isNull(), p)).drop("__p", "__v")


def proposal_actions(parsed: DataFrame, *keys: str) -> DataFrame:
    """Actions of valid proposals: (*keys, ordinal, action_id, evidence)."""
    return parsed.filter("valid").select(
        *keys, F.posexplode(F.col("parsed")["candidate_actions"]).alias("ordinal", "a")
    ).select(*keys, "ordinal", F.col("a")["action_id"].alias("action_id"),
             F.col("a")["evidence"].alias("evidence"))
