"""Licence scans by canonical digests, in DataFrame functions only.

A text's canonical form: lower case; equivalent spellings made one; a title at the start, copyright statements (a year and
a holder's name, of up to 200 characters until a phrase that licences go on with) and list numbers dropped; everything
but letters and digits turned into single spaces. It does not depend on where lines end, or on marks of comments at
their start. Entire texts are licences when the digest of their canonical form is that of a known licence, single lines
when that of their letters and digits is that of a known licence or notice: of a text given, of a text file
in a folder given, or of a long licence whose digest is listed. Null texts are empty; the empty form matches nothing.
Repeated rows, and rows that tie in all columns, stay apart. Columns beside the two named ones are left out. An empty
table gives an empty one. A very long text is one row of a task, and no Python runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_texts import DIGESTS, KNOWN

# Spellings that count as one, after the usual matching guidelines for licence texts.
SPELLINGS = (
    ("licence", "license"), ("sub-license", "sublicense"), ("organisation", "organization"), ("favour", "favor"), ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"), ("behaviour", "behavior"), ("catalogue", "catalog"), ("centre", "center"), ("fulfil ", "fulfill "), ("judgement", "judgment"),
    ("labelling", "labeling"), ("merchantibility", "merchantability"), ("non-commercial", "noncommercial"), ("per cent", "percent"), ("redistributers", "redistributors"),
    ("copyright owner", "copyright holder"), ("whilst", "while"), ("wilful", "willful"), ("https://", "http://"),
)

#: What begins a line and is neither a letter, a digit nor an opening bracket: marks of comments and of lists.
LINE_MARKS = r"(^|\n)[^\p{L}\p{N}\n(©]+"
SPACE = r"[ \t\n\x0B\f\r]+"
#: A word that was cut at its hyphen.
HYPHEN = r"([a-z])- ([a-z])"
#: A title at the start that only names a licence.
TITLE = r"^[^a-z0-9]*(the )?(mit|isc|0bsd|zlib|bsd|new bsd|modified bsd|simplified bsd|bsd [0-4]-clause|[0-4]-clause bsd|bsd zero clause|boost software)( .new. or .revised.| .simplified.)? license( \((mit|isc|0bsd|zlib|bsd)\)| - version 1\.0 - august 17th, 2003)?[^a-z0-9]+"
# How the known texts go on after their copyright statements.
OPENINGS = ("permission is hereby granted", "permission to use", "redistribution and use", "this software is provided", "this is free and unencumbered", "licensed under the", "everyone is permitted", "released under the", "this work is licensed", "all rights reserved")
#: A statement with a year and a holder's name, up to where the text goes on, or its end.
STATEMENT = r"(portions )?(copyright|©|\(c\))( ?(\(c\)|©|copyright))*[ ,:]*[0-9]{4}[^\n]{0,200}?(" + "|".join(OPENINGS) + "|$)"
RESERVED = r"all rights reserved"
#: A number or letter of a list.
LIST_MARK = r"(^| )\(?([0-9]{1,2}|[a-z]|[ivx]{1,4})[.)]+ "


def _forms(lower, replace, pattern, text, group: str):
    """(lines, whole) of a text, made by the functions of either engine; group is how it writes its groups."""
    x = lower(text)
    for a, b in SPELLINGS:
        x = replace(x, a, b)
    lines = pattern(x, r"[^\p{L}\p{N}\n]+", " ")
    x = pattern(pattern(x, LINE_MARKS, f"{group}1"), SPACE, " ")
    x = pattern(x, HYPHEN, f"{group}1-{group}2")
    for a, b in SPELLINGS:
        if not a.isalpha():  # may have stood across a line's end
            x = replace(x, a, b)
    for dropped, left in ((TITLE, ""), (STATEMENT, f" {group}5"), (RESERVED, ""), (LIST_MARK, " "), (LIST_MARK, " ")):
        x = pattern(x, dropped, left)
    return lines, pattern(x, r"[^\p{L}\p{N}]+", " ")


def forms(text: Column) -> tuple[Column, Column]:
    """(lines, whole): the plain form with the text's line ends kept, for single lines; and the canonical form, which is the same wherever lines end."""
    replace = lambda x, a, b: F.replace(x, F.lit(a), F.lit(b))
    pattern = lambda x, p, left: F.regexp_replace(x, F.lit(p), F.lit(left))
    lines, whole = _forms(lambda t: F.lower(F.coalesce(t, F.lit(""))), replace, pattern, text, "$")
    return lines, F.trim(whole)


def digest(canonical: Column) -> Column:
    return F.sha2(canonical.cast("binary"), 256)


def known(spark: SparkSession, texts: dict[str, str] | None = None, folder: str | None = None) -> DataFrame:
    """(digest, license, length) of the known texts: those given and the listed digests, or else those of a folder's text files, named like their licences. Of texts with one digest the first id counts."""
    rows = lambda of, names: spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip(r, names)]) for r in of])))
    if folder is not None:
        name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.txt)?$", 1)
        table = spark.read.text(folder, wholetext=True).select(name.alias("license"), F.col("value").alias("text"))
    else:
        table = rows((texts or KNOWN).items(), ("license", "text"))
    plain, whole = forms(F.col("text"))
    one_line = F.trim(F.replace(plain, F.lit("\n"), F.lit(" ")))
    table = table.select("license", F.explode(F.array_distinct(F.array(whole, F.regexp_replace(one_line, " +", " ")))).alias("form")).filter("form != ''")
    table = table.select("license", digest(F.col("form")).alias("digest"), F.length("form").alias("length"))
    if texts is None and folder is None:
        table = table.unionByName(rows([(k, *v) for k, v in DIGESTS.items()], ("license", "length", "digest")))
    return table.groupBy("digest").agg(F.min("license").alias("license"), F.first("length").alias("length"))


def scan(df: DataFrame, texts: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """(id, digest, license, n_license_lines, line_licenses) of each row: the entire text's canonical digest and its licence (null if unknown), and the licences that single lines are.

    Entire texts and lines meet the known digests in one hash join. Only lines as long as a known form are digested.
    The known table is as large as its parameter, so it is broadcast; what is shuffled is one short row a text and one
    a line found. Repeated rows stay apart.
    """
    of = known(df.sparkSession, texts, folder)
    lengths = F.array(*[F.lit(r.length) for r in of.select("length").distinct().orderBy("length").collect()])
    plain, whole = forms(F.col(text_col))
    own = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col), plain.alias("lines"), whole.alias("form"))
    lines = F.filter(F.transform(F.split("lines", "\n"), lambda x: F.trim(x)), lambda x: F.array_contains(lengths, F.length(x)))
    units = F.concat(
        F.array(F.struct(F.lit(True).alias("whole"), F.col("form").alias("form"))),
        F.transform(lines, lambda x: F.struct(F.lit(False).alias("whole"), x.alias("form"))),
    )
    units = own.select("row", id_col, F.inline(units)).select("row", id_col, "whole", digest(F.col("form")).alias("digest"))
    units = units.join(F.broadcast(of), "digest", "left").filter("whole or license is not null")
    found = units.groupBy("row", id_col).agg(
        F.max(F.when(F.col("whole"), F.col("digest"))).alias("digest"),
        F.max(F.when(F.col("whole"), F.col("license"))).alias("license"),
        F.count(F.when(~F.col("whole"), 1)).alias("n_license_lines"),
        F.array_join(F.array_sort(F.collect_set(F.when(~F.col("whole"), F.col("license")))), ",").alias("line_licenses"),
    )
    return found.drop("row")


def scan_sql(texts: dict[str, str] | None = None, table: str = "documents") -> str:
    """scan in DuckDB's SQL."""

    quoted = lambda t: t.replace("'", "''")
    replace = lambda x, a, b: f"replace({x}, '{a}', '{b}')"
    pattern = lambda x, p, left: f"regexp_replace({x}, '{quoted(p)}', '{left}', 'g')"
    plain, whole = _forms(lambda t: f"lower(coalesce({t}, ''))", replace, pattern, "text", "\\")
    values = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in (texts or KNOWN).items())
    listed = ", ".join(f"('{v[1]}', '{k}')" for k, v in DIGESTS.items()) if texts is None else "(NULL, NULL)"
    one_line = f"trim(regexp_replace(replace({plain}, chr(10), ' '), ' +', ' ', 'g'))"
    return f"""
        WITH known AS (
            SELECT digest, min(license) AS license FROM (
                SELECT sha256(form) AS digest, license FROM (SELECT license, unnest([trim({whole}), {one_line}]) AS form FROM (VALUES {values}) v(license, text)) WHERE form != ''
                UNION ALL SELECT digest, license FROM (VALUES {listed}) d(digest, license)) GROUP BY 1),
        own AS (SELECT row_number() OVER () AS row, doc_id, {plain} AS lines, trim({whole}) AS form FROM {table}),
        units AS (
            SELECT row, doc_id, true AS whole, sha256(form) AS digest FROM own
            UNION ALL SELECT row, doc_id, false, sha256(trim(line)) FROM (SELECT row, doc_id, unnest(string_split(lines, chr(10))) AS line FROM own)),
        found AS (SELECT row, doc_id, whole, digest, license FROM units LEFT JOIN known USING (digest) WHERE whole OR license IS NOT NULL)
        SELECT doc_id, max(digest) FILTER (whole) AS digest, max(license) FILTER (whole) AS license,
            count(*) FILTER (NOT whole) AS n_license_lines,
            coalesce(string_agg(DISTINCT license, ',' ORDER BY license) FILTER (NOT whole), '') AS line_licenses
        FROM found GROUP BY row, doc_id"""
