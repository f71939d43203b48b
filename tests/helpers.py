"""Small frames and rule runs shared by the tests."""


def files_df(spark, rows):
    """rows: list of (path, content) in repo 'r'."""
    from revkit.sources.files import files_from_table

    df = spark.createDataFrame([("r", p, c) for p, c in rows], "repo string, path string, content string")
    return files_from_table(df)


def run(spark, rules, rows):
    from revkit.operators.findings import run_rules

    out = run_rules(files_df(spark, rows), rules).orderBy("path", "rule_seq", "occ").collect()
    return [(r.path, r.rule_id, r.line, r.msg) for r in out]
