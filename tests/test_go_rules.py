"""Hand fixtures for the Go segment rules."""

from helpers import run

from revkit.operators import golang as I


def msgs(spark, content):
    return [m for *_x, m in run(spark, I.rules(), [("svc/a.go", content)])]


def test_long_function_and_doc(spark):
    body = "".join(f"\tx{i} := {i}\n" for i in range(51))
    out = msgs(spark, "// Package a docs\npackage a\n\n// Run runs.\nfunc Run() {\n" + body + "}\n")
    assert "svc/a.go:5: Function 'Run' is too long (51 statements, consider refactoring)" in out
    assert not any("lacks documentation" in m for m in out)


def test_naked_return_and_error_checks(spark):
    src = (
        "package a\n\nfunc Load() (n int, err error) {\n\tif err := f(); err != nil {\n\t\tlog(err)\n\t}\n"
        "\tif err != nil {\n\t\treturn 0, err\n\t}\n\treturn\n}\n"
    )
    out = msgs(spark, src)
    assert "svc/a.go:1: Package lacks documentation comment" in out
    assert "svc/a.go:3: Exported function 'Load' lacks documentation comment" in out
    assert "svc/a.go:10: Naked return in function 'Load' reduces code readability" in out
    assert "svc/a.go:4: Consider separating error assignment and checking for better readability" in out
    assert "svc/a.go:4: Error check doesn't properly return or handle the error" in out
    assert not any(m.startswith("svc/a.go:7:") for m in out)
    # 2 checks, 1 handled: 1 < 2 div 2 is false -> no file-level message
    assert not any("Many error checks" in m for m in out)


def test_many_unhandled_and_context(spark):
    src = 'package a\nimport (\n\t"context"\n\t_ "embed"\n)\nfunc g() {\n\tif err != nil {\n\t}\n\tif err != nil {\n\t}\n}\n'
    out = msgs(spark, src)
    assert "svc/a.go:1: Many error checks don't properly return or handle the error" in out
    assert "svc/a.go:1: Using context package but not passing context through functions" in out
    assert "svc/a.go:4: Blank import found - ensure it's necessary" in out


def test_no_package_means_no_findings(spark):
    assert msgs(spark, "func broken( {\n") == []


def _many_checks(n):
    block = "\tif err := f(); err != nil {\n\t\tlog(err)\n\t}\n\tif err != nil {\n\t\tfor {\n\t\t\treturn x, err\n\t\t}\n\t}\n"
    return "// Package a docs\npackage a\n\nfunc load() (n int, err error) {\n" + block * n + "\treturn\n}\n"


def test_checks_are_closed_once(spark):
    msgs = [m for _, _, _, m in run(spark, I.rules(), [("a.go", _many_checks(3) + "\nfunc open() {\n\tif err != nil {\n\t\treturn\n")])]
    assert sum("Consider separating" in m for m in msgs) == 3
    assert [m.split(":")[1] for m in msgs if "doesn't properly return or handle" in m and "Many" not in m] == ["5", "13", "21", "33"]
    assert not any("Many error checks" in m for m in msgs)  # 3 of 7 are handled
    assert any(":29: Naked return in function 'load'" in m for m in msgs)


def test_time_follows_the_number_of_checks(spark):
    import time

    def seconds(n):
        t = time.perf_counter()
        assert len(run(spark, I.rules(), [("a.go", _many_checks(n))])) > n
        return time.perf_counter() - t

    seconds(50)  # compiled
    few, many = min(seconds(400) for _ in range(2)), min(seconds(1600) for _ in range(2))
    assert many < 10 * few + 2  # four times the text; a square would be sixteen
