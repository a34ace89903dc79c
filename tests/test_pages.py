"""Log rows out of small hand-written pages."""

import datetime

from pyspark.sql import functions as F

from formline.functions.labels import label_table, reason_label
from formline.sources import pages as P
from formline.sources.pages import comment_blocks, gamelog_rows, parse_table, table_html

HEAD = "<tr><th>Rk</th><th>Date</th><th>Tm</th><th></th><th>Opp</th><th>MP</th><th>PTS</th></tr>"
BODY = (
    "<tr><th>1</th><td>2024-01-02</td><td><a href='/x'>BRK</a></td><td>@</td><td>SAS</td><td>33:24</td><td>21</td></tr>"
    + HEAD
    + "<tr><th>2</th><td>2024-01-04</td><td>BRK</td><td></td><td>DEN</td><td>12</td><td>n/a</td></tr>"
    + "<tr><th>3</th><td>2024-01-06</td><td>BRK</td><td></td><td>DEN</td><td colspan='2'>Did Not Play</td></tr>"
    + "<tr><th>Total</th><td></td><td>30 Games</td></tr>"
)


def table(table_id):
    return f"<table class='s' id=\"{table_id}\"><thead>{HEAD}</thead><tbody>{BODY}</tbody></table>"


def pages(spark):
    rows = [
        (1, f"<html><table id='other'><tr><td>1</td></tr></table>{table('player_game_log_reg')}</html>"),
        (2, f"<html><!-- first --><div><!-- {table('pgl_basic')} --></div></html>"),
        (3, "<html><!-- pgl_basic --><p>nothing</p></html>"),
    ]
    return spark.createDataFrame(rows, "page_id int, html string").withColumns(
        {"player_id": F.concat(F.lit("p"), F.col("page_id")), "season": F.lit(2024)}
    )


def test_rows_of_live_and_hidden_tables(spark):
    out = gamelog_rows(pages(spark)).orderBy("page_id", "game_date")
    got = [(r["page_id"], r["player_id"], r["game_date"], r["team"], r["home_game"], r["opponent"], r["minutes"], r["pts"]) for r in out.collect()]
    day = datetime.date
    want = []
    for page in (1, 2):
        want.append((page, f"p{page}", day(2024, 1, 2), "BRK", 0, "SAS", 33.4, 21.0))
        want.append((page, f"p{page}", day(2024, 1, 4), "BRK", 1, "DEN", 12.0, None))
    assert got == want
    assert out.columns[:4] == ["page_id", "row_number", "player_id", "season"]


def test_table_is_found_or_null(spark):
    found = [r[0] for r in pages(spark).orderBy("page_id").select(table_html("html")).collect()]
    assert found[0].startswith("<table class='s' id=\"player_game_log_reg\"") and found[0].endswith("</table>")
    assert "pgl_basic" in found[1] and found[2] is None


def test_comment_blocks(spark):
    out = comment_blocks(pages(spark), wanted=["pgl_basic"]).orderBy("page_id").collect()
    assert [(r["page_id"], r["position"]) for r in out] == [(2, 1), (3, 0)]


def test_parse_table_names_and_padding():
    header, rows = parse_table("<table><tr><th>A</th><th></th><th>A</th></tr><tr><td>1 &amp; 2</td></tr><tr><td colspan=2>x</td><td>y</table>")
    assert header == ["A", "Unnamed: 1", "A.1"]
    assert rows == [["1 & 2", None, None], ["x", "x", "y"]]


def label(spark, feature, contribution, value, **kw):
    row = spark.createDataFrame([(feature, contribution, value)], "f string, c double, v double")
    return row.select(reason_label("f", "c", "v", **kw)).first()[0]


def test_labels(spark):
    assert label(spark, "rolling_last5_pts", 0.4, 21.26) == "Strong recent scoring (last 5 avg: 21.3 pts)"
    assert label(spark, "rolling_last5_minutes_std", -0.4, 5.0) == "Inconsistent minutes (high variance: 5.0)"
    assert label(spark, "rolling_last5_minutes_std", -0.4, 5.0, first_match=True) == "Lighter minutes load recently (5 avg)"
    assert label(spark, "home_game", -0.4, 1.0) == "Home court advantage"
    assert label(spark, "home_game", -0.4, 1.0, first_match=True) == "Away game"
    assert label(spark, "back_to_back", 0.4, 1.0) == "Back-to-back game (fatigue factor)"
    assert label(spark, "season_avg_usage_rate", 0.4, 0.2) == "High usage rate this season"
    assert label(spark, "season_avg_usage_rate", 0.4, 0.2, first_match=True) is None
    assert label(spark, "position_enc", 0.4, 1.0) is None
    assert len(label_table()) == 23


def test_nested_and_row_spanning_cells(spark):
    """A nested table is part of its cell, and a cell that spans rows counts in each of them."""
    nested = BODY.replace("<td>33:24</td>", "<td>33:24<table><tr><td></td></tr></table></td>")
    spanning = (
        "<tr><th>1</th><td rowspan='2'>2024-01-02</td><td rowspan=2>BRK</td><td>@</td><td>SAS</td><td>33:24</td><td>21</td></tr>"
        "<tr><th>2</th><td></td><td>DEN</td><td>12</td><td>7</td></tr>"
    )
    rows = [(k, f"<html><table id='pgl_basic'><thead>{HEAD}</thead><tbody>{b}</tbody></table></html>") for k, b in enumerate((nested, spanning))]
    out = gamelog_rows(spark.createDataFrame(rows, "page_id int, html string")).orderBy("page_id", "row_number")
    got = [(r["page_id"], str(r["game_date"]), r["opponent"], r["minutes"], r["pts"]) for r in out.collect()]
    assert got[:2] == [(0, "2024-01-02", "SAS", 33.4, 21.0), (0, "2024-01-04", "DEN", 12.0, None)]
    assert got[2:] == [(1, "2024-01-02", "SAS", 33.4, 21.0), (1, "2024-01-02", "DEN", 12.0, 7.0)]


def test_extraction_reads_the_pages_once(spark):
    plan = gamelog_rows(pages(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("MapInPandas") == 1


def test_known_tags_need_no_html_parser(monkeypatch):
    """Tables of well-formed known tags give the parser's rows without it; all others still go through it."""
    plain = [
        table("pgl_basic"), "<table></table>", "<table><tr><td>a<td colspan='2'> b &amp;\n c <tr><th rowspan=2>d</th><td>e</table>",
        "<TABLE id=x><THEAD><tr><th>A</thead><tr><td class=\"a b\">1<br><b>2</b></td></tr><tr></tr></TABLE>",
        "<table>x<td>no row</td><tr>y<td>1</td>z<thead><tr><th>late</th></table>", "<table><tr><td colspan=''>a</td><td colspan=x rowspan=0>b</td></tr>",
    ]
    others = ["<table><tr><td>1<!-- <td> --></td></table>", "<table><tr><td>a < b</table>", "<table><tr><td><table><tr><td>x</table></td></table>",
              "<table><tr><td title='>'>1</td></table>", "<table><tr><td>1<script><td>2</script></table>", "", "text"]
    fed = []
    feed = P._TableParser.feed
    monkeypatch.setattr(P._TableParser, "feed", lambda self, markup: (fed.append(markup), feed(self, markup))[1])
    quick = [parse_table(markup) for markup in plain + others]
    assert fed == others
    monkeypatch.setattr(P, "_feed_plain", lambda parser, markup: False)
    assert [parse_table(markup) for markup in plain + others] == quick


def test_comments_are_parted_as_the_pattern_finds_them():
    import re

    for html in ("a<!--b-->c", "<!-->x-->y", "<!---->", "<!-- a <!-- b --> c -->", "a<!-- open", "", "-->a<!--\n-->"):
        assert P._parted(html) == (re.sub(P.COMMENT, "", html), "\n".join(re.findall(P.COMMENT, html)))
