"""Sources and sinks, and log rows out of pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from formline import bindings as B
from formline.operators.rows import default_columns
from formline.session import new_path, stored
from formline.sources import pages as P
from formline.sources import tables as S

from . import query, rounded, sql


@query("src_csv_typed", "select o_orderkey, o_custkey, o_totalprice, o_orderdate::date as o_orderdate, o_orderstatus from orders")
def csv_typed(spark, sf):
    path = new_path(spark, "csv")
    rows = B.table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", F.to_date("o_orderdate").alias("o_orderdate"), "o_orderstatus"
    )
    S.write_csv(rows, path)
    return S.read_csv(spark, path, rows.schema)


@query(
    "src_html_list_links",
    """
select page_id, i - 1 as position, l[i][1] as href, l[i][2] as text, title from (
  select page_id, regexp_extract(html, '<title>(.*?)</title>', 1, 's') as title,
    list_zip(regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 1),
      regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 2)) as l from pages), unnest(range(1, len(l) + 1)) as t(i)
""".replace("i - 1 as position", "(i - 1)::int as position"),
)
def html_links(spark, sf):
    pages = B.table(spark, sf, "pages")
    titles = pages.select("page_id", P.page_title("html").alias("title"))
    return P.page_links(pages).join(titles, "page_id")


@query(
    "src_html_comment_blocks",
    """
select page_id, (i - 1)::int as position, c[i] as comment from (select page_id,
  regexp_extract_all(html, '<!--(.*?)-->', 1, 's') as c from pages), unnest(range(1, len(c) + 1)) as t(i)
where contains(c[i], 'ad')""",
)
def comment_blocks(spark, sf):
    return P.comment_blocks(B.table(spark, sf, "pages"), wanted=["ad"])


LISTED = ["pts", "no_such_feature", "minutes", "reb"]


@query(
    "src_feature_list",
    sql("select pts, minutes, reb, 3.5::double as rolling_last5_minutes_std from game_logs", "game_logs"),
)
def feature_list(spark, sf):
    rows = default_columns(B.game_logs(spark, sf), {"rolling_last5_minutes_std": 3.5})
    path = new_path(spark, "names")
    spark.createDataFrame([("\n".join(LISTED),)], "value string").coalesce(1).write.text(path)
    return rows.select(*S.feature_list(S.read_feature_list(spark, path), rows))


@query(
    "src_json_fields",
    """
select event_id, json_extract_string(props, '$.k')::int as k, strftime(ts, '%Y-%m-%d') as date,
  case upper(event_type) when 'CLICK' then 'CLICK' else upper(event_type) end as home_code,
  ['GSW', 'SAS', 'LAL'][(event_id % 3 + 1)::int] as visitor_code
from events""",
)
def json_fields(spark, sf):
    short = F.element_at(F.array(F.lit("gs"), F.lit("SA"), F.lit("lal")), (F.col("event_id") % 3 + 1).cast("int"))
    day = F.to_date("ts").cast("string")
    event = F.struct(
        F.col("event_id").alias("id"), day.alias("date"),
        F.struct(F.col("event_type").alias("abbreviation")).alias("home_team"),
        F.struct(short.alias("abbreviation")).alias("visitor_team"),
    )
    payloads = B.table(spark, sf, "events").select(
        S.json_field("props", "$.k").cast("int").alias("k"),
        F.to_json(F.struct(F.array(event).alias("data"))).alias("payload"),
    )
    return S.scheduled_events(payloads, keep=["k"])


@query("snk_table", sql("select game_id, season, team_id, value from schedule", "schedule"))
def sink_table(spark, sf):
    path = new_path(spark, "table")
    rows = B.schedule(spark, sf).select("game_id", "season", "team_id", "value")
    S.write_table(rows, path, period="season")
    return S.read_table(spark, path, rows.schema)


HEADER = ("Rk", "G", "Date", "Tm", "", "Opp", "", "GS", "MP", "FGA", "FTA", "TRB", "TOV", "PTS", "New")


def log_pages(spark, sf):
    """One page per event, rendered by Spark: a log table, live or inside a comment, or none.

    Every table repeats its header and holds a total and a row that was not played.
    The log is dealt evenly before its pages, a hundred times as large, are made of it.
    """
    logs = B.game_logs(spark, sf).repartition(4 * spark.sparkContext.defaultParallelism)
    gid = F.col("game_id")
    minutes = F.concat(F.coalesce("minutes", F.lit(0.0)).cast("int").cast("string"), F.lit(":"), F.lpad((gid % 60).cast("string"), 2, "0"))
    cells = [
        gid.cast("string"), F.lit("1"), F.col("game_day").cast("string"), F.col("team_abbrev"),
        F.when(F.col("home_game") == 1, "").otherwise("@"), F.col("opponent_abbrev"), F.coalesce("result", F.lit("")),
        F.col("gs").cast("string"), minutes, *[F.col(c).cast("string") for c in ("fga", "fta", "reb", "tov", "pts")],
        F.lit("a &amp; b"),
    ]
    row = F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td><b>"), c, F.lit("</b></td>")) for c in cells], F.lit("</tr>"))
    head = "<tr>" + "".join(f"<th>{h}</th>" for h in HEADER) + "</tr>"
    idle = F.concat(
        F.lit("<tr><td>9</td><td></td><td>"), F.col("game_day").cast("string"),
        F.lit("</td><td></td><td></td><td></td><td></td><td></td><td colspan='7'>Did Not Play</td></tr>"),
    )
    total = "<tr><td>Total</td><td></td><td></td><td>30 Games</td></tr>"
    table = F.concat(
        F.when(gid % 2 == 0, '<table class="x" id="player_game_log_reg">').otherwise("<table id='pgl_basic'>"),
        F.lit(f"<thead>{head}</thead><tbody>"), row, F.lit(head), idle, F.lit(f"{total}</tbody></table>"),
    )
    body = F.when(gid % 3 == 0, table).when(gid % 3 == 1, F.concat(F.lit("<!-- \n"), table, F.lit("-->")))
    html = F.concat(F.lit("<html><!-- pgl_basic --><table id='other'><tr><td>x</td></tr></table>"), F.coalesce(body, F.lit("")))
    pages = logs.select(gid.alias("page_id"), html.alias("html"), "player_id", "player_name", "position", "season")
    return stored(pages, "pages")


@query(
    "pip_gamelog_extract",
    sql(
        """
select game_id as page_id, player_id, player_name, position, season, game_day as game_date, team_abbrev as team,
  home_game, opponent_abbrev as opponent, coalesce(result, '') as result,
  round(coalesce(minutes, 0)::int + (game_id % 60) / 60.0::double, 6) as minutes, gs::double as gs, fga, fta, reb as trb,
  tov, pts, 'a & b' as extra_new
from game_logs where game_id % 3 <> 2""",
        "game_logs",
    ),
)
def gamelog_extract(spark, sf):
    rows = P.gamelog_rows(log_pages(spark, sf))
    rows = rows.withColumns({"extra_new": F.col("extra")["New"], "result": F.coalesce("result", F.lit(""))})
    return rounded(
        rows, "page_id", "player_id", "player_name", "position", "season", "game_date", "team", "home_game", "opponent",
        "result", "minutes", "gs", "fga", "fta", "trb", "tov", "pts", "extra_new",
    )


@query(
    "src_html_regular_rows",
    sql(
        "select game_id as page_id, 1::int as position, game_id::varchar as first_cell, team_abbrev as fourth_cell "
        "from game_logs where game_id % 3 <> 2",
        "game_logs",
    ),
)
def regular_rows(spark, sf):
    rows = P.regular_rows(log_pages(spark, sf)).where("position = 1")
    return rows.select(
        "page_id", "position", F.element_at("cells", 1).alias("first_cell"), F.element_at("cells", 4).alias("fourth_cell")
    )


ROW_SQL = "game_id::varchar || '|1|' || game_day::varchar || '|' || team_abbrev || '|' || case home_game when 1 then '?' else '@' end || '|' || opponent_abbrev"


@query(
    "src_html_table_rows",
    sql(
        f"""
select game_id as page_id, p::int as position, case p when 0 then {ROW_SQL} when 1 then '{"|".join(h or "?" for h in HEADER[:6])}'
  when 2 then '9|?|' || game_day::varchar || '|?|?|?' else 'Total|?|?|30 Games|?|?' end as first_cells, {len(HEADER)}::int as n_headers
from game_logs, unnest(range(4)) as t(p) where game_id % 3 <> 2""",
        "game_logs",
    ),
)
def html_rows(spark, sf):
    """Every row of the wanted table of every page, whether live or in a comment, by the parser; empty cells are null."""
    tables = P.parsed_tables(log_pages(spark, sf))
    rows = tables.select("page_id", F.size("header").alias("n_headers"), F.posexplode("cells").alias("position", "cells"))
    return rows.select("page_id", "position", F.array_join(F.slice("cells", 1, 6), "|", "?").alias("first_cells"), "n_headers")
