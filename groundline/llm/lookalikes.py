"""One consistent form for texts that look the same (problem 1).

DuckDB runs inside each Arrow partition. One embedded statement, built from the tables below, maps every text:

1. invisible characters go, line ends and blanks of every kind become line feed and blank (one for one);
2. wide and narrow forms become the usual ones, half-width kana with their voice marks included;
3. look-alike letters of other scripts become the Latin letter of the same shape, accented ones too;
4. ``nfc_normalize`` puts accented letters together.

The result is the key by which texts are compared (``skeleton``). For reading, words that hold letters of Cyrillic or
Greek that have no Latin twin, and no Latin letter without a twin in that script, get that script's letters back (``form``). The way back is a
function of the skeleton alone, so equal skeletons have equal forms and the other way round.

A visible difference stays: case, accents, digits, raised digits, visible signs, wording, the number of blanks, the order of lines. NFKC would lose raised
digits and is not used.

Edge cases: a null text has a null form; an empty text an empty one. A text of invisible characters only becomes empty and is in no pair.
Repeated rows keep their rows. Texts of any length are mapped whole. Extra columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundline.runtime import cut, spread

#: Copies of one text, about, that one task expands.
HOT = 20_000

#: Letters of other scripts and the letters of the same shape.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХҮԌԚԜӀаеѕіјорсухһԁԛԝүѵӏ", "ABESIJKMHOPCTYXYGQWIaesijopcyxhdqwyvl", strict=True))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳονϲ", "ABEZHIKMNOPTYXCjovc", strict=True))
ARMENIAN = dict(zip("ՕՍՏԼօսհոցզ", "OUSLouhngq", strict=True))
CHEROKEE = dict(zip("ᎠᎡᎢᎥᎪᎫᎬᎳᎶᎷᎻᎽᏀᏃᏏᏒᏔᏙᏚᏞᏟᏢᏦᏧᏳᏴ", "DRTiAJEWGMHYGZbRWVSLCPKdGB", strict=True))
NUMERALS = dict(zip("ⅠⅤⅩⅬⅭⅮⅯⅰⅴⅹⅼⅽⅾⅿ", "IVXLCDMivxlcdm", strict=True))
OTHERS = dict(zip("ɑɡⲞⲟꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "agOoBPDTGKJCZFMNLSRVHWXYAEIOU", strict=True))


def accented(letters: dict[str, str]) -> dict[str, str]:
    """The letters that NFC makes of a twin and a mark, where it also makes one of the Latin letter and the mark."""
    marks = [chr(c) for c in range(0x300, 0x370) if unicodedata.combining(chr(c))]
    made = ((unicodedata.normalize("NFC", own + m), unicodedata.normalize("NFC", latin + m)) for own, latin in letters.items() for m in marks)
    return {own: latin for own, latin in made if len(own) == len(latin) == 1}


#: By rule: accented letters of the same shape as accented Latin ones.
ACCENTED = accented(CYRILLIC | GREEK | ARMENIAN | CHEROKEE | NUMERALS | OTHERS)
#: Characters that show nothing, and blanks and line ends of other kinds.
INVISIBLE = "\\x{00AD}\\x{034F}\\x{061C}\\x{115F}\\x{1160}\\x{17B4}\\x{17B5}\\x{180B}-\\x{180E}\\x{200B}-\\x{200F}\\x{202A}-\\x{202E}\\x{2060}-\\x{206F}\\x{3164}\\x{FE00}-\\x{FE0F}\\x{FEFF}\\x{FFA0}\\x{FFF9}-\\x{FFFB}\\x{1BCA0}-\\x{1BCA3}\\x{1D173}-\\x{1D17A}\\x{E0000}-\\x{E0FFF}\\x{0000}-\\x{0008}\\x{000E}-\\x{001B}\\x{007F}-\\x{0084}\\x{0086}-\\x{009F}"
BLANKS = "\\x{0009}\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{202F}\\x{205F}\\x{3000}\\x{001F}"
LINE_ENDS = "\\r\\n|[\\r\\x{000B}\\x{000C}\\x{0085}\\x{2028}\\x{2029}\\x{001C}-\\x{001E}]"


def forms() -> dict[str, str]:
    """Wide and narrow forms with the usual form of each, by the rule of the Unicode data; voice marks become combining ones."""
    out = {"ﾞ": "゙", "ﾟ": "゚"}
    for code in range(0xFF01, 0xFFEF):
        kind, _, to = unicodedata.decomposition(chr(code)).partition(" ")
        if kind in ("<wide>", "<narrow>") and chr(code) not in out and code != 0xFFA0:
            out[chr(code)] = chr(int(to, 16))
    return out


def twins() -> dict[str, str]:
    """Every look-alike letter with its Latin letter; the mathematical alphabets by the rule of the Unicode data."""
    out = CYRILLIC | GREEK | ARMENIAN | CHEROKEE | NUMERALS | OTHERS | ACCENTED
    for code in range(0x1D400, 0x1D6A4):
        kind, _, to = unicodedata.decomposition(chr(code)).partition(" ")
        if kind == "<font>":
            out[chr(code)] = chr(int(to, 16))
    return out


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def skeleton_sql(text: str = "text") -> str:
    """The statement's expression for the key of a text."""
    table = {k: v for k, v in (forms() | twins()).items() if k != v and len(v) == 1}
    # a wide letter may itself have a twin (none has, but the rule must not depend on it)
    table = {k: table.get(v, v) for k, v in table.items()}
    seen = f"regexp_replace({text}, '[{INVISIBLE}]+', '', 'g')"
    lines = f"regexp_replace({seen}, '{LINE_ENDS}', chr(10), 'g')"
    blanks = f"regexp_replace({lines}, '[{BLANKS}]', ' ', 'g')"
    # twice composed: first a base and its mark may make a letter that has a twin, then a twin and its mark a letter
    return f"nfc_normalize(translate(nfc_normalize({blanks}), {quoted(''.join(table))}, {quoted(''.join(table.values()))}))"


def form_sql(skeleton: str = "skeleton") -> str:
    """The expression for the readable form: words of Cyrillic and Greek get their own letters back."""
    word = f"regexp_extract_all({skeleton}, '[\\p{{L}}\\p{{M}}]+|[^\\p{{L}}\\p{{M}}]+')"
    whens = []
    for script, letters in (("Cyrillic", CYRILLIC), ("Greek", GREEK)):
        back: dict[str, str] = {}
        for own, latin in (letters | {k: v for k, v in ACCENTED.items() if unicodedata.name(k).startswith(script.upper())}).items():
            back.setdefault(latin, own)
        free = "".join(c for c in (chr(i) for i in range(0x41, 0x250)) if c.isalpha() and c not in back)
        whens.append(f"WHEN regexp_matches(w, '\\p{{{script}}}') AND NOT regexp_matches(w, '[{free}]') THEN translate(w, {quoted(''.join(back))}, {quoted(''.join(back.values()))})")
    return f"array_to_string(list_transform({word}, lambda w: CASE {' '.join(whens)} ELSE w END), '')"


def consistent(df: DataFrame, id_col: str, text_col: str = "text", readable: bool = True) -> DataFrame:
    """id_col, skeleton, and with ``readable`` form, of every row."""
    kind = df.schema[id_col].dataType.simpleString()
    columns = "id, skeleton" + (f", {form_sql()} AS form" if readable else "")
    sql = f"SELECT {columns} FROM (SELECT id, {skeleton_sql()} AS skeleton FROM part)"
    names = [id_col, "skeleton", "form"][: 3 if readable else 2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": "1GB"})
        for batch in batches:
            part = pa.Table.from_batches([batch]).rename_columns(["id", "text"])
            con.register("part", part)
            out = con.sql(sql).to_arrow_table()
            con.unregister("part")
            yield from out.rename_columns(names).cast(pa.schema([(names[0], batch.schema.field(0).type), *((n, pa.string()) for n in names[1:])])).to_batches()

    return spread(df.select(F.col(id_col), F.col(text_col).cast("string"))).mapInArrow(run, f"{id_col} {kind}, skeleton string" + (", form string" if readable else ""))


def look_alike_pairs(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """Pairs of rows whose texts differ but look the same: (id)_a and (id)_b, the smaller first.

    The texts leave their partition as two 128-bit digests only, of the text and of its skeleton. Different texts of one look are paired
    first, each once however many copies it has; then both are expanded to their rows. Rows of a text with more than ``HOT`` copies are
    divided over several tasks (there are at most rows / ``HOT`` such texts, which is what is broadcast).
    """
    rows = df.select(F.struct(F.col(id_col).alias("id"), F.md5(F.col(text_col).cast("binary")).alias("own")).alias("row"), F.col(text_col).alias("text")).where("text <> ''")
    keys = consistent(rows, "row", "text", readable=False).where("skeleton <> ''").select("row.id", "row.own", F.md5(F.col("skeleton").cast("binary")).alias("look"))
    keys = cut(keys)
    texts = cut(keys.groupBy("look", "own").agg(F.ceil(F.count("*") / HOT).alias("parts")))
    hot = F.broadcast(texts.where("parts > 1").select("own", F.col("parts").alias("of")))
    members = keys.join(hot, "own", "left").select("own", "id", F.pmod(F.xxhash64("id"), F.coalesce("of", F.lit(1))).alias("part"))
    a, b = (texts.select("look", F.col("own").alias(x), F.col("parts").alias(f"parts_{x}")) for x in "ab")
    pairs = a.join(b, "look").where("a < b")
    for x in "ab":
        pairs = pairs.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"parts_{x}") - 1)))
        pairs = pairs.join(members.select(F.col("own").alias(x), "part", F.col("id").alias(f"id_{x}")), [x, "part"]).drop("part")
    first, last = F.least("id_a", "id_b"), F.greatest("id_a", "id_b")
    return pairs.where("id_a <> id_b").select(first.alias(f"{id_col}_a"), last.alias(f"{id_col}_b")).distinct()


def look_alike_sql(table: str, id_col: str, text_col: str = "text") -> str:
    """look_alike_pairs as one statement of DuckDB."""
    return f"""WITH k AS (SELECT DISTINCT {id_col} AS id, {text_col} AS own, {skeleton_sql(text_col)} AS look FROM {table} WHERE {text_col} <> '')
SELECT DISTINCT x.id AS {id_col}_a, y.id AS {id_col}_b FROM k x JOIN k y ON x.look = y.look AND x.id < y.id AND x.own <> y.own WHERE x.look <> ''"""
