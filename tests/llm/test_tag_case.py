"""Tag names of any case end lines, and scripts and styles go."""

from revkit.llm import line_dedup


def test_upper_and_mixed_case_tags(spark):
    pages = {
        "low": "<html><script>var t='</p>';</script><style>p {}</style><p>menu</p><table><tr><td>body {}</td></tr></table><br>foot</html>",
        "up": "<HTML><SCRIPT>var t='</P>';</SCRIPT><STYLE>P {}</STYLE><P>menu</P><TABLE><TR><TD>body {}</TD></TR></TABLE><BR>foot</HTML>",
        "mix": "<Html><Script>var t='</p>';</scripT><sTyle>p {}</Style><p>menu</P><Table><Tr><tD>body {}</Td></tR></taBle><bR>foot</hTml>",
    }
    rows = [(10 * k + i, f"http://{name}.example/{i}", html.replace("body {}", f"body {i}")) for k, (name, html) in enumerate(pages.items()) for i in range(6)]
    got = {r.page_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(6):
        for k in range(3):
            assert (got[10 * k + i].n_lines, got[10 * k + i].n_dropped, got[10 * k + i].text) == (3, 2, f"body {i}")
