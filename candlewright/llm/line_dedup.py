"""Site-relative line deduplication: lines that too large a share of a host's pages hold are boilerplate of the site.

All of it is DataFrame functions. Each page counts once for each of its distinct lines; counts are pre-aggregated before
the shuffle. What comes back for a host is only its boilerplate lines, of which there are at most mean-lines / ratio, and
they are dropped from the pages where those are, so no page is taken apart and put together again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import host_of, join_spread, materialize, own_prefix, with_results

#: Share of a host's pages above which a line is boilerplate, and least pages of a host to judge by.
RATIO, LEAST_PAGES = 0.2, 5
#: Up to so many boilerplate lines in all, they are broadcast (8 bytes each); beyond, they are joined by host.
BROADCAST_LINES = 500_000
#: Up to so many hosts, their page totals are broadcast (about 40 bytes each); beyond, they are joined by shuffle.
BROADCAST_HOSTS = 200_000
UNSEEN = r"(?is)<!--.*?-->|<(script|style|head)\b.*?</\1\s*>"
BREAKS = r"(?i)\s*</?(?:p|div|br|li|ul|ol|h[1-6]|tr|td|th|table|section|article|header|footer|nav|aside|main|form|blockquote|pre|hr|body|html)\b[^>]*>\s*"
TAG = r"<[^>]*>"


def html_lines(html: Column) -> Column:
    """The page's lines: text between block tags, without other tags, scripts, styles and comments."""
    seen = F.regexp_replace(F.coalesce(html, F.lit("")), UNSEEN, "")
    return F.regexp_replace(F.regexp_replace(seen, BREAKS, "\n"), TAG, "")


def lines_of(text: Column) -> Column:
    """Lines with something else than white space, trimmed of spaces, tabs and carriage returns."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(" \t\r"))), lambda x: x != "")


def site_lines(pages: DataFrame, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(host, bad): hashes of each host's boilerplate lines, for pages (host, lines). The page total of a host rides along as
    the line hash null. A host's lines lie in as many tasks as they need; its total goes to each. Null lists have no lines, and no
    ties arise, as each line is counted by itself."""
    hashes = F.array_distinct(F.transform("lines", lambda x: F.xxhash64(x)))
    keys = F.explode(F.concat(F.array(F.lit(None).cast("bigint")), hashes))
    counts = materialize(pages.select("host", keys.alias("line")).groupBy("host", "line").agg(F.count("*").alias("n")), "line-counts")
    totals = counts.filter(F.col("line").isNull() & (F.col("n") >= least_pages)).select("host", F.col("n").alias("total"))
    lines = counts.filter(F.col("line").isNotNull())
    bad = join_spread(lines, totals, "host", "line", BROADCAST_HOSTS).filter(F.col("n") > ratio * F.col("total"))
    return materialize(bad.groupBy("host").agg(F.collect_list("line").alias("bad")), "site-lines")


def drop_site_lines(pages: DataFrame, text: Column, host: Column, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """pages with `host`, `text` (lines that stay, joined by line feeds), `n_lines` and `n_dropped`.

    A line is dropped from every page of its host if more than `ratio` of the host's pages hold it and the host has at
    least `least_pages` pages; repeated rows are pages of their own, and a line that comes twice in a page counts once.
    Null texts have no lines, pages with a null or odd URL form one site, and an empty table gives an empty result. Very
    long texts are cut into lines whole. Columns of the four names, in whatever case, are replaced; all others stay,
    whatever their names.
    """
    own = own_prefix(pages)
    site, lines, bad_lines, stay, spread = (f"{own}{c}" for c in ("host", "lines", "bad", "stay", "spread"))
    rows = pages.withColumns({lines: lines_of(text), site: F.coalesce(host, F.lit(""))})
    bad = site_lines(rows.select(F.col(site).alias("host"), F.col(lines).alias("lines")), ratio, least_pages).withColumnsRenamed({"host": site, "bad": bad_lines})
    few = (bad.agg(F.sum(F.size(bad_lines))).first()[0] or 0) <= BROADCAST_LINES
    if few:
        rows = rows.join(F.broadcast(bad), site, "left")
    else:
        rows = join_spread(rows.withColumn(spread, F.xxhash64(lines)), bad, site, spread, -1, "left")
    kept = F.filter(lines, lambda x: ~F.array_contains(F.col(bad_lines), F.xxhash64(x)))
    rows = rows.withColumn(stay, F.when(F.col(bad_lines).isNull(), F.col(lines)).otherwise(kept))
    n_lines = F.size(lines).cast("bigint")
    return with_results(rows, own, {"host": F.col(site), "text": F.array_join(stay, "\n"), "n_lines": n_lines, "n_dropped": n_lines - F.size(stay)})


#: The same in DuckDB, for the pages table.
LINES_SQL = r"""
WITH p AS (SELECT row_number() OVER () AS r, page_id, lower(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1)) AS host,
        regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<!--.*?-->', '', 'g'),
'(?is)<script\b.*?</script\s*>', '', 'g'), '(?is)<style\b.*?</style\s*>', '', 'g'), '(?is)<head\b.*?</head\s*>', '', 'g'),
          '(?i)\s*</?(?:p|div|br|li|ul|ol|h[1-6]|tr|td|th|table|section|article|header|footer|nav|aside|main|form|blockquote|pre|hr|body|html)\b[^>]*>\s*', chr(10), 'g'), '<[^>]*>', '', 'g') AS t FROM pages),
l AS (SELECT r, page_id, host, list_filter(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, '^[ \t\r]+|[ \t\r]+$', '', 'g')),
lambda x: x <> '') AS ls FROM p),
x AS (SELECT r, page_id, host, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM l),
tot AS (SELECT host, count(*) AS total FROM l GROUP BY host),
bad AS (SELECT host, line FROM (SELECT DISTINCT r, host, line FROM x) JOIN tot USING (host)
GROUP BY host, line, total HAVING total >= 5 AND count(*) > 0.2 * total),
k AS (SELECT r, string_agg(line, chr(10) ORDER BY i) AS text, count(*) AS n FROM x ANTI JOIN bad USING (host, line) GROUP BY r)
SELECT page_id, host, coalesce(text, '') AS text, len(ls)::BIGINT AS n_lines, (len(ls) - coalesce(n, 0))::BIGINT AS n_dropped
FROM l LEFT JOIN k USING (r)
"""
