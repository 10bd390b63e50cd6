"""Splitting oversized items at natural boundaries (problem 5).

One regular expression with bounded quantifiers consumes a text from left to right: its alternatives are ordered by the
strength of the boundary they end at, each greedy up to the budget, and single characters are the last resort. The first
piece has the whole limit, later ones what the overlap leaves. The overlap is looked up in the pieces before by array
functions, and the pieces tell whether a cut was made inside a stretch without white space; everything stays in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrion.session import read_table

#: Most characters of a piece, and how many of them repeat the end of the piece before.
LIMIT, OVERLAP = 6000, 300


def boundary_pattern(budget: int) -> str:
    """Consumes at most ``budget`` characters up to the strongest boundary in the second half of the budget.

    In order: the rest of the text; before a heading; after a blank line; after a line; after a sentence; after a word,
    wherever it stands; any character that no combining mark follows; any character.
    """
    half = max(1, budget // 2)
    upto = lambda tail, width: f".{{{min(half, max(1, budget - width))},{max(1, budget - width)}}}{tail}"
    return "|".join([
        rf".{{1,{budget}}}\z",
        upto(r"\n(?=#{1,6}[ \t])", 1),
        upto(r"\n\r?\n", 3),
        upto(r"\n", 1),
        upto(r"(?:[.!?…][\"'»”)]?[ \t\r]|[。！？])", 3),
        rf".{{1,{max(1, budget - 1)}}}[ \t\r\n]",
        rf".{{1,{budget}}}(?![\p{{M}}‍\n])",
        rf".{{1,{budget}}}",
    ])


def split_text(text: Column, limit: int = LIMIT, overlap: int = OVERLAP) -> Column:
    """Array of pieces of at most ``limit`` characters; each after the first begins with the last ``overlap`` characters of the one before.

    A text within the limit is one piece; null and empty texts have none. ``limit`` must be more than twice ``overlap``.
    """
    if not 0 <= overlap * 2 < limit:
        raise ValueError("limit must be more than twice overlap")
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).when(F.length(text) <= limit, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(rf"(?s)\A(?:{boundary_pattern(limit)})|(?:{boundary_pattern(limit - overlap)})"), F.lit(0)))


def longest_cut_stretch(fresh: Column) -> Column:
    """Length of the longest stretch without white space that goes on across a cut between pieces; 0 where all cuts are at white space."""
    blank = lambda p: F.translate(p, "\t\r\n", "   ")

    def step(state: Column, p: Column) -> Column:
        head, tail = F.length(F.substring_index(blank(p), " ", 1)), F.length(F.substring_index(blank(p), " ", -1))
        whole = head == F.length(p)
        across = F.when(state["open"] > 0, F.when(head > 0, state["open"] + head).otherwise(0)).otherwise(0)
        # What is open at the end of a piece: all of it where it has no white space, else what follows the last.
        return F.struct(F.when(whole, state["open"] + head).otherwise(tail).alias("open"), F.greatest(state["longest"], across).alias("longest"))

    return F.aggregate(fresh, F.struct(F.lit(0).alias("open"), F.lit(0).alias("longest")), step, lambda state: state["longest"])


def with_overlap(fresh: Column, overlap: int = OVERLAP) -> Column:
    """The pieces with the overlap before them. Of two pieces in a row one at least is longer than the overlap."""
    if overlap == 0:
        return fresh
    behind = lambda i: F.right(F.concat(F.when(i >= 2, F.element_at(fresh, F.greatest(i - 1, F.lit(1)))).otherwise(""), F.element_at(fresh, F.greatest(i, F.lit(1)))), F.lit(overlap))
    return F.transform(fresh, lambda p, i: F.when(i == 0, p).otherwise(F.concat(behind(i), p)))


def split_records(df: DataFrame, id_column: str, text_column: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of every text: id, piece_no (from 1), piece, n_pieces and cut_kind.

    cut_kind is null for a text within the limit, ``inside`` when a cut went through a stretch without white space that is
    itself longer than the limit, else ``boundary``. Defined cases: null and empty texts and null ids give no rows; other columns are ignored,
    whatever their names; a record given twice gives its pieces twice (drop copies before); an empty table gives no rows.
    """
    rows = df.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).where("text <> '' and id is not null")
    rows = rows.select("id", split_text(F.col("text"), limit, overlap).alias("fresh"))
    kind = F.when(F.size("fresh") > 1, F.when(longest_cut_stretch(F.col("fresh")) > limit, "inside").otherwise("boundary"))
    rows = rows.select("id", "fresh", kind.alias("cut_kind"))
    rows = rows.select("id", "cut_kind", F.size("fresh").alias("n_pieces"), F.posexplode(with_overlap(F.col("fresh"), overlap)).alias("piece_no", "piece"))
    return rows.select(F.col("id").alias(id_column), (F.col("piece_no") + 1).alias("piece_no"), "piece", "n_pieces", "cut_kind")


def p5_pieces(spark, sf_dir: str) -> DataFrame:
    """All pieces of all captures; the deliveries of one capture hold the same text and become one."""
    pieces = split_records(read_table(spark, sf_dir, "captures"), "capture_id", "markdown")
    return pieces.dropDuplicates(["capture_id", "piece_no"])


def p5_checks(spark, sf_dir: str) -> DataFrame:
    """For each capture the characters that its pieces hold without what overlaps, and how many pieces are longer than the limit."""
    length = F.length("piece")
    # What a piece gives to the next one; the last gives nothing.
    repeated = F.when(F.col("piece_no") < F.col("n_pieces"), F.least(length, F.lit(OVERLAP))).otherwise(0)
    return p5_pieces(spark, sf_dir).groupBy("capture_id").agg(F.sum(length - repeated).alias("n_characters"), F.count_if(length > LIMIT).alias("n_too_long"))


def p5_found(spark, sf_dir: str) -> DataFrame:
    pieces = split_records(read_table(spark, sf_dir, "captures"), "capture_id", "markdown")
    return pieces.where("piece_no = 1 and cut_kind is not null").select("capture_id", "cut_kind").distinct()


P5_SQL = r"""
SELECT DISTINCT capture_id, CASE WHEN list_max(list_transform(regexp_split_to_array(markdown, '[ \t\r\n]'), lambda s: length(s))) > 6000 THEN 'inside' ELSE 'boundary' END AS cut_kind
FROM captures WHERE length(markdown) > 6000
"""
P5_CHECKS_SQL = "SELECT DISTINCT capture_id, length(markdown) AS n_characters, CAST(0 AS BIGINT) AS n_too_long FROM captures WHERE markdown <> ''"
