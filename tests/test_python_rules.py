"""Hand fixtures for the order-dependent Python checks."""

from helpers import run

from revkit.operators import python as H


def codes(spark, content, path="src/m.py"):
    rows = run(spark, H.rules(), [(path, content)])
    return [(m.split(" ")[1], m.split(": ", 1)[0].split(" ")[0]) for _p, _r, _l, m in rows], [m for *_x, m in rows]


def test_unbalanced_delimiters_per_line(spark):
    _c, msgs = codes(spark, "x = (a]\ny = 'é)'\nz = [1, 2]\n")
    assert "m.py:1:7 [error] PYL001: Unbalanced delimiter: ']'" in msgs
    # byte column: 'é' is two bytes, so ')' sits at byte index 7 -> column 8
    assert "m.py:2:8 [error] PYL001: Unbalanced delimiter: ')'" in msgs
    assert not any(":3:" in m and "PYL001" in m for m in msgs)


def test_indent_stack_quirk(spark):
    _c, msgs = codes(spark, "def f():\n    if x:\n        pass\n  y = 1\n")
    # an indented colon line is flagged against its own pushed level
    assert "m.py:2:1 [error] PYL003: Indentation error: expected 8 spaces, got 4" in msgs
    assert "m.py:4:1 [error] PYL003: Indentation error: expected 0 spaces, got 2" in msgs


def test_function_too_long_and_nested_def_ends_it(spark):
    body = "".join(f"    x{i} = {i}\n" for i in range(55))
    _c, msgs = codes(spark, "def big():\n" + body + "def small():\n    return 1\n")
    assert any("PYL302: Function 'big' is too long (56 lines)" in m and m.startswith("m.py:1:1") for m in msgs)
    assert not any("'small'" in m and "PYL302" in m for m in msgs)


def test_function_length_counted_until_dedent(spark):
    body = "".join(f"    x{i} = {i}\n" for i in range(50))
    _c, msgs = codes(spark, "def edge():\n" + body + "\n# c\ny = 2\n")
    assert any("Function 'edge' is too long (51 lines)" in m for m in msgs)


def test_quote_balance(spark):
    _c, msgs = codes(spark, "a = 'x'\nb = 'y'\nc = \"z\"\nd = 'w'\ne = 'v'\n")
    assert "m.py:1:1 [info] PYL502: Inconsistent quote style. Consider using consistent string quotes" in msgs


def test_group_order_checks_only_present_index(spark):
    # third-party + local without standard: the local group is compared with
    # 'standard' (absent), so no order issue is reported
    _c, msgs = codes(spark, "import my_local_module\nimport requests\n")
    assert not any("PYL203" in m for m in msgs)
    _c, msgs = codes(spark, "import requests\nimport os\n")
    assert "m.py:1:1 [info] PYL203: Imports are not grouped in the correct order (standard, third-party, local)" in msgs


def test_basename_in_location(spark):
    _c, msgs = codes(spark, "except:\n    pass\n", path="deep/dir/x.py")
    assert msgs[0].startswith("x.py:1:1 [warning] PYL101")
