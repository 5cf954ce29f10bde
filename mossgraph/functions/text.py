"""Text functions as column expressions: tokens, hashes, snippets, leads and summaries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that tokens leave out, fixed values.
STOPWORDS = (
    "the and for with this that from are was were but not you your have has had will would could should into onto over than then them they their there what when which while where who whom whose why how"
).split()
#: Dimensions of the hashed embedding.
DIM = 384
#: FNV-1a, 64 bits: offset basis and prime, fixed values.
FNV_BASIS, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def lines(text: str = "text") -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n")


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits of two bytes or more that aren't stop words; duplicates stay."""
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: (F.octet_length(t) >= 2) & ~F.array_contains(stop, t))


def bigrams(words: Column) -> Column:
    """Neighbouring tokens, joined by a space."""
    n = F.size(words)
    return F.when(n > 1, F.zip_with(F.slice(words, F.lit(1), n - 1), F.slice(words, F.lit(2), n - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))


def fnv1a_halves(value: Column) -> Column:
    """FNV-1a of a string's UTF-8 bytes as two 32-bit halves, since a product of longs may overflow under ANSI rules."""
    data = value.cast("binary")
    bytes_ = F.transform(F.sequence(F.lit(1), F.octet_length(value)), lambda i: F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 10).cast("long"))
    low32 = F.lit(0xFFFFFFFF)

    def step(state: Column, byte: Column) -> Column:
        low = state["lo"].bitwiseXOR(byte)
        carried = F.shiftright(low * 435, 32)  # the prime is 2 ** 40 + 435
        return F.struct((state["hi"] * 435 + carried + low * 256).bitwiseAND(low32).alias("hi"), (low * 435).bitwiseAND(low32).alias("lo"))

    basis = F.struct(F.lit(FNV_BASIS >> 32).cast("long").alias("hi"), F.lit(FNV_BASIS & 0xFFFFFFFF).cast("long").alias("lo"))
    return F.when(F.octet_length(value) > 0, F.aggregate(bytes_, basis, step)).otherwise(basis)


def fnv1a_hex(halves: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(halves["hi"]), 8, "0"), F.lpad(F.hex(halves["lo"]), 8, "0")))


def bucket(halves: Column, dim: int = DIM) -> Column:
    return ((halves["hi"] % dim) * ((1 << 32) % dim) + halves["lo"]) % dim


def sign(halves: Column) -> Column:
    """Minus one where bit 56 of the hash is set."""
    return F.when(F.shiftright(halves["hi"], 24).bitwiseAND(F.lit(1)) == 0, F.lit(1)).otherwise(F.lit(-1))


def fnv1a(value: str) -> int:
    h = FNV_BASIS
    for byte in value.encode():
        h = ((h ^ byte) * FNV_PRIME) & 0xFFFFFFFFFFFFFFFF
    return h


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def capped(text: Column, n: int) -> Column:
    """The first n characters, with an ellipsis if there are more."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


def visible_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+")).cast("long")


def leading_text(text: Column, n: int) -> Column:
    """The first paragraphs up to about n characters: headings are skipped, lines of a paragraph are joined by spaces,
    and an empty line starts a new line."""

    def add(so_far: Column, line: Column) -> Column:
        trimmed = F.trim(line)
        glue = F.when((so_far == "") | so_far.endswith(" ") | so_far.endswith("\n"), F.lit("")).otherwise(F.lit(" "))
        grown = F.when(trimmed.startswith("#"), so_far).when(trimmed == "", F.when(so_far == "", so_far).otherwise(F.concat(so_far, F.lit("\n")))).otherwise(F.concat(so_far, glue, trimmed))
        return F.when(F.length(so_far) >= n, so_far).otherwise(grown)

    return capped(F.aggregate(F.split(F.coalesce(text, F.lit("")), "\n"), F.lit(""), add), n)


def snippet(text: Column, query: str, before: int = 40, after: int = 140, plain: int = 180) -> Column:
    """The part of a text around the first match of a query, on one line, with ellipses where it was cut."""
    at = F.locate(query.lower(), F.lower(text))
    start = F.when(at > 0, F.greatest(at - 1 - before, F.lit(0))).otherwise(F.lit(0))
    stop = F.when(at > 0, F.least(at - 1 + len(query) + after, F.length(text))).otherwise(F.least(F.length(text), F.lit(plain)))
    part = F.replace(F.substring(text, start + 1, stop - start), F.lit("\n"), F.lit(" "))
    return F.concat(F.when(start > 0, F.lit("…")).otherwise(F.lit("")), part, F.when(stop < F.length(text), F.lit("…")).otherwise(F.lit("")))


def token_estimate(text: Column) -> Column:
    return F.ceil(F.octet_length(F.trim(text)) / 4).cast("long")


#: For SQL that has to give the same tokens.
SQL_STOP = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"
SQL_TOKENS = rf"list_filter(regexp_split_to_array(lower({{0}}), '[^\p{{{{L}}}}\p{{{{N}}}}]+'), lambda x: octet_length(encode(x)) >= 2 AND NOT list_contains({SQL_STOP}, x))".replace("{{{{", "{{").replace("}}}}", "}}")
SQL_BLOCKS = "blocks AS (SELECT doc_id, line, content FROM (SELECT doc_id, unnest(l) AS content, unnest(range(len(l))) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)) WHERE trim(content) <> '')"


def sql_fnv(value: str) -> str:
    return f"list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(range(octet_length(encode({value}))), lambda i: ('0x' || substr(hex(encode({value})), (2 * i + 1)::BIGINT, 2))::INT::UHUGEINT)), lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)"
