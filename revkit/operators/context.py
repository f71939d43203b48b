"""J14/J15 code references in comments and M2-M6 file context joins.

Joins carry keys and bins of lines: a text is read and split once, and
references meet the bins of lines that their range touches by an equi-join whose
hot keys adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revkit.functions import text as T
from revkit.session import ensure_checkpoint_dir

# Reference patterns and the named references of the sample
# requests (file name -> line range), and the context labels in match order.
REFERENCE = r"(?i)([\w./-]+):(\d+)(?:-(\d+))?"
NAMED_FILES = [("UserAuthentication.java", 45, 52), ("user_service.py", 10, 20), ("auth.js", 15, 30)]
CONTEXT_LABELS = ["validateToken", "authenticate_user", "login"]


def extract_references(comments: DataFrame, named: bool = True) -> DataFrame:
    """(review_id, ref_seq, filename, line_start, line_end) per reference.

    Sources in order: 'path:a[-b]' references, then the fixed named files
    mentioned anywhere in the text. A missing end equals the start."""
    m = F.col("message")
    zipped = F.arrays_zip(
        T.extract_all(m, REFERENCE, 1).alias("f"), T.extract_all(m, REFERENCE, 2).alias("a"), T.extract_all(m, REFERENCE, 3).alias("b")
    )
    by_regex = F.transform(
        zipped,
        lambda z: F.struct(
            z["f"].alias("filename"),
            z["a"].try_cast("int").alias("line_start"),
            F.coalesce(F.nullif(z["b"], F.lit("")).try_cast("int"), z["a"].try_cast("int")).alias("line_end"),
        ),
    )
    parts = [by_regex]
    if named:
        fixed = F.array(
            *[
                F.when(F.contains(m, F.lit(name)), F.struct(F.lit(name).alias("filename"), F.lit(a).alias("line_start"), F.lit(b).alias("line_end")))
                for name, a, b in NAMED_FILES
            ]
        )
        parts.append(F.filter(fixed, lambda x: x.isNotNull()))
    refs = F.concat(*parts)
    keep = [c for c in comments.columns if c != "message"]
    return comments.select(*keep, F.posexplode(refs).alias("pos", "r")).select(
        *keep, (F.col("pos") + 1).alias("ref_seq"), "r.filename", "r.line_start", "r.line_end"
    )


def relevant_context(text: Column, labels=CONTEXT_LABELS) -> Column:
    """First label contained in the text, else 'unknown_context'."""
    out = F.lit("unknown_context")
    for lab in reversed(labels):
        out = F.when(F.contains(text, F.lit(lab)), F.lit(lab)).otherwise(out)
    return out


def resolve_files(refs: DataFrame, files: DataFrame) -> DataFrame:
    """M2: match each reference to a file of its repo by path, exactly first,
    else case-insensitively (smallest matching path). Only keys are joined."""
    keys = files.select("repo", "path")
    r = refs.withColumn("want", F.trim(F.col("filename")))
    exact = keys.select("repo", F.col("path").alias("want"), F.col("path").alias("exact_path"))
    folded = keys.groupBy("repo", F.lower("path").alias("want_low")).agg(F.min("path").alias("fold_path"))
    out = (
        r.join(exact, ["repo", "want"], "left")
        .withColumn("want_low", F.lower("want"))
        .join(folded, ["repo", "want_low"], "left")
    )
    return out.withColumn("path", F.coalesce("exact_path", "fold_path")).drop("exact_path", "fold_path", "want_low")


def clamp(start: Column, end: Column, total: Column) -> tuple[Column, Column]:
    """M4: reference range clamp, in the reference's order."""
    s1 = F.when(start <= 0, F.lit(1)).otherwise(start)
    e1 = F.when((end <= 0) | (end < s1), s1).otherwise(end)
    over = s1 > total
    s2 = F.when(over, F.lit(1)).otherwise(s1)
    e2 = F.when(over, F.least(total, F.lit(10))).when(e1 > total, total).otherwise(e1)
    return s2, e2


#: Lines of one bin of a file.
BIN = 64


def line_bins(refs: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, path, total, bin, part): the lines of the files that are referred to,
    in bins of ``BIN`` lines. Each text is read and split once, however many
    references it has, and written to the checkpoint folder."""
    ensure_checkpoint_dir(files.sparkSession)
    wanted = refs.where(F.col("path").isNotNull()).select("repo", "path").distinct()
    texts = files.select("repo", "path", "content").join(wanted, ["repo", "path"], "left_semi")
    lined = texts.select("repo", "path", T.lines(F.col("content")).alias("lines"))
    last = F.floor((F.size("lines") - 1) / BIN).cast("int")
    bins = F.transform(F.sequence(F.lit(0), last), lambda b: F.struct(b.alias("bin"), F.slice("lines", b * BIN + 1, F.lit(BIN)).alias("part")))
    return lined.select("repo", "path", F.size("lines").alias("total"), F.explode(bins).alias("b")).select("repo", "path", "total", "b.bin", "b.part").checkpoint()


def _totals(bins: DataFrame) -> DataFrame:
    return bins.where("bin = 0").select("repo", "path", "total")


def in_range(ranges: DataFrame, bins: DataFrame) -> DataFrame:
    """M3: the range join. ``ranges`` has (repo, path, lo, hi), 0-based and ``hi``
    exclusive; each row meets the bins that it touches by an equi-join on (repo,
    path, bin), and ``shown`` is its part of the bin's lines, from line ``at`` on."""
    touched = F.sequence(F.floor(F.col("lo") / BIN).cast("int"), F.floor((F.col("hi") - 1) / BIN).cast("int"))
    met = ranges.where("hi > lo").withColumn("bin", F.explode(touched)).join(bins.select("repo", "path", "bin", "part"), ["repo", "path", "bin"])
    first = F.col("bin") * BIN
    met = met.withColumn("at", F.greatest(F.col("lo"), first))
    return met.withColumn("shown", F.slice("part", F.col("at") - first + 1, F.least(F.col("hi"), first + BIN) - F.col("at"))).drop("part")


def context_blocks(refs: DataFrame, files: DataFrame) -> DataFrame:
    """M3-M5: per reference the fenced context block (or the retrieval error).

    Lines shown: 0-based [max(0, start-3), min(total, end+3)), '> ' on the
    referenced lines, '%4d' numbers. The text of a range is made once, for all
    references to it."""
    resolved = resolve_files(refs, files)
    bins = line_bins(resolved, files)
    hit = resolved.where(F.col("path").isNotNull()).join(_totals(bins), ["repo", "path"])
    s, e = clamp(F.col("line_start"), F.col("line_end"), F.col("total"))
    hit = hit.withColumn("s", s).withColumn("e", e)
    lo, hi = F.greatest(F.lit(0), F.col("s") - 3), F.least(F.col("total"), F.col("e") + 3)
    ranges = hit.select("repo", "path", "s", "e", lo.alias("lo"), hi.alias("hi")).distinct()
    numbered = F.transform(
        "shown",
        lambda t, k: F.concat(
            F.when((F.col("at") + k + 1 >= F.col("s")) & (F.col("at") + k + 1 <= F.col("e")), F.lit("> ")).otherwise(F.lit("  ")),
            F.format_string("%4d", F.col("at") + k + 1), F.lit(": "), t, F.lit("\n"),
        ),
    )
    pieces = in_range(ranges, bins).select("repo", "path", "s", "e", "at", F.array_join(numbered, "").alias("piece"))
    bodies = pieces.groupBy("repo", "path", "s", "e").agg(F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("ps"))
    hit = hit.join(bodies, ["repo", "path", "s", "e"], "left")
    body = F.coalesce(F.array_join(F.transform("ps", lambda x: x["piece"]), ""), F.lit(""))
    block = F.concat(
        F.lit("Context for "), F.col("filename"), F.lit(" (lines "), F.col("s").cast("string"), F.lit("-"), F.col("e").cast("string"),
        F.lit("):\n```\n"), body, F.lit("```\n\n"),
    )
    keep = [c for c in refs.columns]
    found = hit.select(*keep, F.col("s").alias("shown_start"), F.col("e").alias("shown_end"), block.alias("block"))
    missing = resolved.where(F.col("path").isNull()).select(
        *keep, F.lit(None).cast("int").alias("shown_start"), F.lit(None).cast("int").alias("shown_end"),
        F.concat(F.lit("Error retrieving "), F.col("filename"), F.lit(": file not found: "), F.trim(F.col("filename")), F.lit("\n\n")).alias("block"),
    )
    return found.unionByName(missing)


def enhanced_comments(comments: DataFrame, blocks: DataFrame) -> DataFrame:
    """Comment text followed by its blocks in reference order (bounded by one
    comment's references) and the J15 label of the result."""
    per = blocks.groupBy("review_id").agg(F.array_sort(F.collect_list(F.struct("ref_seq", "block"))).alias("bs"))
    out = comments.join(per, "review_id", "inner").select(
        "review_id",
        F.concat(F.col("message"), F.lit("\n\n"), F.array_join(F.transform("bs", lambda x: x["block"]), "")).alias("enhanced_comment"),
    )
    return out.withColumn("code_context", relevant_context(F.col("enhanced_comment")))


def targeted_lines(refs: DataFrame, files: DataFrame) -> DataFrame:
    """M3 for the targeted rules E8-E10: lines of each (clamped) reference
    range as rows (file_path, line_no, line, ref keys). The clamp is the
    targeted variant: start >= 1, end <= total."""
    bins = line_bins(refs, files)
    keep = [c for c in refs.columns if c not in ("repo", "path")]
    hit = refs.where(F.col("path").isNotNull()).join(_totals(bins), ["repo", "path"])
    lo, hi = F.greatest(F.col("line_start"), F.lit(1)) - 1, F.least(F.col("line_end"), F.col("total"))
    met = in_range(hit.withColumn("lo", lo).withColumn("hi", hi), bins)
    return met.select("repo", "path", *keep, "at", F.posexplode("shown").alias("k", "line")).select(
        "repo", "path", *keep, F.col("path").alias("file_path"), (F.col("at") + F.col("k") + 1).alias("line_no"), "line"
    )


def branch_resolve(snapshots: DataFrame) -> DataFrame:
    """M6: one content row per (provider, owner, repo, path): github prefers
    'main' then 'master'; other providers read 'main' only."""
    from pyspark.sql import Window

    rank = F.when(F.col("branch") == "main", F.lit(1)).when((F.col("provider") == "github") & (F.col("branch") == "master"), F.lit(2))
    w = Window.partitionBy("provider", "owner", "repo", "path").orderBy("branch_rank")
    return (
        snapshots.withColumn("branch_rank", rank)
        .where(F.col("branch_rank").isNotNull())
        .withColumn("rn", F.row_number().over(w))
        .where(F.col("rn") == 1)
        .drop("rn", "branch_rank")
    )
