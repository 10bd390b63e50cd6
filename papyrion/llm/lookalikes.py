"""Visually identical text with different characters (problem 1).

The look-alike mapping writes every letter in one script's form where several scripts draw it alike, undoes width forms
and joined forms, and makes spaces of a space's width plain. The rest is the collation's work: under Spark's UNICODE
collation (accent- and case-sensitive) composed and decomposed accents are equal and what isn't drawn doesn't count.
Values are grouped under that collation, the smallest member in code point order is the class's canonical form, and it
is joined back to every value.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrion.session import materialize, read_table

# Letters of other scripts and phonetic alphabets, each under the letter it is drawn like.
LOOKALIKES = {
    "A": "ΑАᎪ", "B": "ΒВᏴ", "C": "СϹᏟ", "D": "Ꭰ", "E": "ΕЕᎬ", "G": "Ꮐ", "H": "ΗНᎻ", "I": "ΙІӀ", "J": "ЈᎫͿ", "K": "ΚКᏦ\u212a", "L": "Ꮮ",
    "M": "ΜМᎷ", "N": "Ν", "O": "ΟОՕ", "P": "ΡРᏢ", "Q": "Ԛ", "R": "Ꭱ", "S": "ЅՏᏚ", "T": "ΤТᎢ", "V": "ѴᏙ", "W": "ԜᎳ", "X": "ΧХ", "Y": "ΥҮ", "Z": "ΖᏃ",
    "a": "ɑаα", "c": "сϲ", "d": "ԁ", "e": "е", "g": "ɡց", "h": "һհ", "i": "і", "j": "јϳ", "l": "ӏ", "n": "ո", "o": "οоօ", "p": "рρ",
    "q": "ԛ", "s": "ѕ", "u": "ս", "v": "νѵ", "w": "ԝ", "x": "х", "y": "уү", "ə": "ә", "ɛ": "ε", "ヘ": "へ", "ベ": "べ", "ペ": "ぺ",
}
# Accented letters of those scripts whose base is drawn alike, under the accented letter they are drawn like.
ACCENTED = {"Ë": "Ё", "ë": "ё", "Ï": "ΪЇ", "ï": "ї", "È": "Ѐ", "è": "ѐ", "Á": "Ά", "É": "Έ", "Í": "Ί", "Ó": "Ό", "Ý": "Ύ", "Ÿ": "Ϋ", "ó": "ό", "á": "ά"}
# Letters joined into one character.
JOINED = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "ſt", "ﬆ": "st", "Ĳ": "IJ", "ĳ": "ij", "Ǉ": "LJ", "ǈ": "Lj", "ǉ": "lj", "Ǌ": "NJ", "ǋ": "Nj", "ǌ": "nj", "Ǳ": "DZ", "ǲ": "Dz", "ǳ": "dz", "ﬓ": "մն", "ﬔ": "մե", "ﬕ": "մի", "ﬖ": "վն", "ﬗ": "մխ"}
#: Roman numerals are drawn as letters; their compatibility forms say as which.
JOINED |= {ch: plain for ch in map(chr, range(0x2160, 0x2180)) if len(plain := unicodedata.normalize("NFKC", ch)) > 1}
# No-break, three-per-em, four-per-em, figure, thin, narrow no-break and medium mathematical space.
SPACES = "\u00a0\u2004\u2005\u2007\u2009\u202f\u205f"


def _width_forms() -> dict[str, str]:
    """Full- and half-width letters and digits; signs keep their width."""
    out = {}
    for code in range(0xFF01, 0xFFDD):
        ch = chr(code)
        plain = unicodedata.normalize("NFKC", ch)
        if len(plain) == 1 and plain != ch and unicodedata.category(plain)[0] in "LNM":
            out[ch] = plain
    out["\uff9e"], out["\uff9f"] = "\u3099", "\u309a"
    return out


def _single() -> dict[str, str]:
    table = {other: base for base, others in {**LOOKALIKES, **ACCENTED}.items() for other in others}
    table |= {s: " " for s in SPACES}
    table |= {ch: plain for ch in map(chr, range(0x2160, 0x2180)) if len(plain := unicodedata.normalize("NFKC", ch)) == 1}
    for wide, plain in _width_forms().items():
        table[wide] = table.get(plain, plain)
    return table


_FROM, _TO = zip(*sorted(_single().items()), strict=True)
# Marks under the letter stand before marks above it, as canonical order has them; ICU compares such text as it stands.
_ABOVE, _BELOW = r"[\u0300-\u0314\u033D-\u0344\u0346\u034A-\u034C\u0350-\u0352\u0357\u035B\u0363-\u036F]", r"[\u0316-\u0319\u031C-\u0333\u0339-\u033C\u0347-\u0349\u034D\u034E\u0353-\u0356]"


#: Blocks that hold mapped, joined or combining characters: a quick test before the mapping.
_BLOCKS = r"[ ĲĳǄ-ǳɐ-ͯͰ-֏Ꭰ-᏿ -⁯KⅠ-ⅿ぀-ゟﬀ-ﬗ＀-￯]"


def lookalike_form(df: DataFrame, value: str, name: str) -> DataFrame:
    """Adds ``name``: ``value`` with look-alikes, width forms, joined forms and spaces in one form; accents and case stay.

    Each step is a projection of its own, so that no step's expression is repeated in the next one's branches.
    """
    v, n, touched = F.col(value), F.col(name), F.col("__touched")
    df = df.withColumn("__touched", v.rlike(_BLOCKS))
    joined = v
    for one, many in JOINED.items():
        joined = F.replace(joined, F.lit(one), F.lit(many))
    df = df.withColumn(name, F.when(touched & v.rlike(r"[ĲĳǄ-ǳⅠ-ⅿﬀ-ﬗ]"), joined).otherwise(v))
    df = df.withColumn(name, F.when(touched, F.translate(n, "".join(_FROM), "".join(_TO))).otherwise(n))
    return df.withColumn(name, F.when(touched & n.rlike(_ABOVE + _BELOW), F.regexp_replace(n, f"({_ABOVE}+)({_BELOW}+)", "$2$1")).otherwise(n)).drop("__touched")


# The characters that the UNICODE collation passes over (controls, joiners, selectors, marks of cantillation and music).
_PASSED_OVER = (
    "["
    r"\u0001-\u0008\u000E-\u001F\u007F-\u0084\u0086-\u009F\u00AD\u034F\u0488-\u0489\u0591-\u05AF\u05BD\u05C4-\u05C5\u0600-\u0605\u0610-\u061A\u061C\u0640"
    r"\u06D6-\u06DD\u06DF-\u06E4\u06E7-\u06E8\u06EA-\u06ED\u070F\u0740\u0743-\u0744\u0747-\u074A\u07FA\u0890-\u0891\u0898-\u089D\u08CA-\u08E2\u08EA-\u08EF"
    r"\u08F3\u0951-\u0952\u0F18-\u0F19\u0F35\u0F37\u0F3E-\u0F3F\u0F86-\u0F87\u0FC6\u17B4-\u17B5\u17D3\u180A-\u180F\u1A7F\u1B6B-\u1B73\u1CD0-\u1CE8\u1CF4"
    r"\u1CF7-\u1CF9\u200B-\u200F\u202A-\u202E\u2060-\u2064\u2066-\u206F\u2D7F\uA670-\uA672\uA8E0-\uA8F1\uFE00-\uFE0F\uFE21\uFE23-\uFE26\uFE28\uFE2A-\uFE2D"
    r"\uFE2F\uFE73\uFEFF\uFFF9-\uFFFB\x{102E0}\x{10EFD}-\x{10EFF}\x{110BD}\x{110CD}\x{11366}-\x{1136C}\x{11370}-\x{11374}\x{113E1}-\x{113E2}"
    r"\x{13430}-\x{13440}\x{13447}-\x{13455}\x{16FE4}\x{1BCA0}-\x{1BCA3}\x{1CF00}-\x{1CF2D}\x{1CF30}-\x{1CF46}\x{1D165}-\x{1D169}\x{1D16D}-\x{1D182}"
    r"\x{1D185}-\x{1D18B}\x{1D1AA}-\x{1D1AD}\x{1D242}-\x{1D244}\x{1DA00}-\x{1DA36}\x{1DA3B}-\x{1DA6C}\x{1DA75}\x{1DA84}\x{1DA9B}-\x{1DA9F}"
    r"\x{1DAA1}-\x{1DAAF}\x{1E8D0}-\x{1E8D6}\x{E0001}\x{E0020}-\x{E007F}\x{E0100}-\x{E01EF}"
    "]"
)
# Common characters that are neither passed over nor digits; they are told apart first, since the class above is slow.
_COMMON = r"\t\n\r -~\u00C0-\u034E\u0350-\u037D\u037F-\u0482\u048A-\u0590\u2010-\u2029\u2030-\u205F\u20A0-\u214F\u2190-\u245F\u2500-\u2775\u3000-\u3006\u3008-\u3020\u302A-\u318F\u3400-\uA61F\uAC00-\uD7A3\uFF00-\uFF9F\x{1F300}-\x{1FAFF}"
# Two signs and the newest digits.
_MORE = "\u037E\u1FEF\U00010D40\U000116D0\U000116DA\U00011BF0\U00016130\U00016D70\U0001E5F1\U00010D41\U000116D1\U000116DB\U00011BF1\U00016131\U00016D71\U0001E5F2\U00010D42\U000116D2\U000116DC\U00011BF2\U00016132\U00016D72\U0001E5F3\U00010D43\U000116D3\U000116DD\U00011BF3\U00016133\U00016D73\U0001E5F4\U00010D44\U000116D4\U000116DE\U00011BF4\U00016134\U00016D74\U0001E5F5\U00010D45\U000116D5\U000116DF\U00011BF5\U00016135\U00016D75\U0001E5F6\U00010D46\U000116D6\U000116E0\U00011BF6\U00016136\U00016D76\U0001E5F7\U00010D47\U000116D7\U000116E1\U00011BF7\U00016137\U00016D77\U0001E5F8\U00010D48\U000116D8\U000116E2\U00011BF8\U00016138\U00016D78\U0001E5F9\U00010D49\U000116D9\U000116E3\U00011BF9\U00016139\U00016D79\U0001E5FA\u212A"
# Signs and digits of other scripts that equal an ASCII character under that collation.
_ASCII_LIKE = {chr(c): str(int(n)) for c in range(0x80, 0x20000) if unicodedata.category(chr(c))[0] == "N" and (n := unicodedata.numeric(chr(c), -1)) in range(10)} | dict(zip(_MORE, ";`0000000111111122222223333333444444455555556666666777777788888889999999K", strict=True))


def with_signature(df: DataFrame, mapped: str, name: str) -> DataFrame:
    """Adds ``name``: a hash that is equal for values equal under the collation.

    It is taken of the ASCII characters, without letters (and = < >) that bear a combining mark: as one character or as
    two, an accented letter then leaves nothing. What the collation passes over goes first, since some of it are marks
    by category (U+034F, variation selectors) and any may stand between a letter and its accent; digits of other scripts
    count as the ASCII ones that they equal.
    """
    m, n, odd = F.col(mapped), F.col(name), F.col("__odd")
    df = df.withColumn("__odd", m.rlike(f"[^{_COMMON}]"))
    df = df.withColumn(name, F.when(odd, F.regexp_replace(m, f"(?![{_COMMON}]){_PASSED_OVER}", "")).otherwise(m))
    df = df.withColumn(name, F.when(n.rlike(r"[\u0300-\u036F]"), F.regexp_replace(n, r"[A-Za-z=<>](?=\p{M}*[\u0300-\u036F])", "")).otherwise(n))
    digits = rf"(?![{_COMMON}])[[\p{{N}}&&[^0-9]]{_MORE}]"
    df = df.withColumn(name, F.when(odd & n.rlike(digits), F.translate(n, "".join(_ASCII_LIKE), "".join(_ASCII_LIKE.values()))).otherwise(n))
    return df.withColumn(name, F.xxhash64(F.regexp_replace(n, r"[^\t\n\r -~]+", ""))).drop("__odd")


def lookalike_classes(values: DataFrame) -> DataFrame:
    """Classes of values that look the same, only those with two or more different values.

    ``values`` has field_name, record_id, value; other columns are ignored. Returns field_name, class_form (the class's
    canonical form), variant (SHA-256 of the value) and record_id, one row per record and value. A value left out here
    resembles no other: its canonical form is its own ``lookalike_form``.

    Defined cases: null and empty values and null ids take no part; a record given twice with one value counts once,
    with two values each counts; records whose values are equal character by character are members of one variant; an
    empty table gives no rows. Texts are compared whole at any length.
    """
    rows = values.select("field_name", "record_id", "value").where("value is not null and value <> '' and record_id is not null")
    # A value whose signature no other value has resembles none; hashes alone tell that.
    keyed = with_signature(lookalike_form(rows.withColumn("vh", F.xxhash64("value")), "value", "mapped"), "mapped", "sig")
    keyed = materialize(keyed.select("field_name", "record_id", "sig", "vh"))
    shared = keyed.groupBy("field_name", "sig").agg(F.min("vh").alias("lo"), F.max("vh").alias("hi")).where("lo <> hi")
    near = materialize(keyed.join(shared.select("field_name", "sig"), ["field_name", "sig"]).select("field_name", "record_id", "sig").distinct())
    near = materialize(rows.join(near, ["field_name", "record_id"]).withColumn("variant", F.sha2("value", 256)))
    variants = near.groupBy("field_name", "sig", "variant").agg(F.first("value").alias("value"))
    variants = lookalike_form(variants, "value", "mapped").withColumn("form", F.collate("mapped", "UNICODE"))
    classes = variants.groupBy("field_name", "sig", "form").agg(F.min("mapped").alias("class_form"), F.count("*").alias("n")).where("n > 1")
    members = variants.select("field_name", "sig", "form", "variant").join(classes.select("field_name", "sig", "form", "class_form"), ["field_name", "sig", "form"]).select("field_name", "variant", "class_form")
    return near.select("field_name", "variant", "record_id").distinct().join(members, ["field_name", "variant"]).select("field_name", "class_form", "variant", "record_id")


def unify(values: DataFrame) -> DataFrame:
    """Every value with its one consistent form: ``value`` and ``form`` for each (field_name, record_id).

    Values of a class get the class's canonical form, all others their own ``lookalike_form``; null and empty stay.
    """
    classes = lookalike_classes(values).select("field_name", "record_id", "variant", "class_form")
    own = lookalike_form(values.select("field_name", "record_id", "value"), "value", "mapped").withColumn("variant", F.sha2("value", 256))
    return own.join(classes, ["field_name", "record_id", "variant"], "left").select("field_name", "record_id", "value", F.coalesce("class_form", "mapped").alias("form"))


def lookalike_pairs(values: DataFrame) -> DataFrame:
    """Pairs of different records whose values look the same but aren't equal: field_name, left_id < right_id."""
    members = materialize(lookalike_classes(values))
    variants = members.select("field_name", F.sha2("class_form", 256).alias("class_id"), "variant").distinct()
    pairs = variants.join(variants.withColumnRenamed("variant", "other"), ["field_name", "class_id"]).where("variant < other").drop("class_id")
    ids = members.select("field_name", "variant", "record_id")
    both = pairs.join(ids.withColumnRenamed("record_id", "a"), ["field_name", "variant"]).join(ids.select("field_name", F.col("variant").alias("other"), F.col("record_id").alias("b")), ["field_name", "other"])
    return both.where("a <> b").select("field_name", F.least("a", "b").alias("left_id"), F.greatest("a", "b").alias("right_id")).distinct()


def _fields(spark, sf_dir: str) -> DataFrame:
    """field_name, record_id and value of both fields of all captures."""
    captures = read_table(spark, sf_dir, "captures")
    fields = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in ("title", "markdown")])).alias("f")
    return captures.select(F.col("capture_id").alias("record_id"), fields).select("record_id", "f.*")


def p1_found(spark, sf_dir: str) -> DataFrame:
    return lookalike_pairs(_fields(spark, sf_dir))


def p1_classes(spark, sf_dir: str) -> DataFrame:
    """One row for each class of different values that look the same: its canonical form, its number of different values and of captures.

    Unlike the pairs, which grow with the square of a class, the classes grow with the captures.
    """
    classes = lookalike_classes(_fields(spark, sf_dir)).groupBy("field_name", "class_form")
    return classes.agg(F.countDistinct("variant").alias("n_variants"), F.countDistinct("record_id").alias("n_captures"))


def p1_forms(spark, sf_dir: str) -> DataFrame:
    """capture_id, field_name and form: both fields of every capture in one consistent form, each capture and value once."""
    return unify(_fields(spark, sf_dir).dropDuplicates()).select(F.col("record_id").alias("capture_id"), "field_name", "form")
