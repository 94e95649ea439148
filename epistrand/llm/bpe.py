"""Byte-level BPE encoding and decoding by Spark's higher-order functions.

A text is cut by the tokenizer's pattern, and each word becomes an array of byte pieces, in
hexadecimal. A fold over that array joins the neighbours of lowest rank until no two
neighbours are a token; ranks come from a literal map in the plan. Decoding looks each id up
in a literal array and joins the pieces. Literals are rows of a local relation: Spark keeps the
text of every plan, and prints other literals there with all they hold.

The commonest distinct words of the whole table, at most ``COMMON`` of them, are folded once
and looked up in a scalar of the plan; the fold encodes all other words where they stand. So
texts are never shuffled, only distinct words with their counts. Nothing here runs in Python
but the making of the literals.
"""

import base64
import functools
import json
import sys
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epistrand.functions.arrays import bind
from epistrand.operators.lookup import find, lookup_value
from epistrand.sources import local_table, materialize

RANKS = "byte_bpe_50k.tiktoken"
# So many of the commonest words are sent to all tasks, at most COMMON_BYTES bytes each.
COMMON = 262_144
COMMON_BYTES = 64
# Tasks that fold the common words.
TASKS = 24
# Words of more bytes are cut first where no token can lie, and equal pairs are joined at once.
LONG = 24
_NO_RANK = 2**31 - 1
# Bits of a place in a word; ranks stand above them.
_PLACE = 31


def _place(first: Column) -> Column:
    return first.bitwiseAND(F.lit((1 << _PLACE) - 1)).cast("int")


class Literal:
    """A value that is part of the plan, but not of its text. It reaches tasks as one block of memory."""

    def __init__(self, value: object, kind: pa.DataType):
        self.held = pa.array([value], kind)

    def scalar(self, spark: SparkSession) -> Column:
        """The value as a scalar subquery, which lambdas cannot hold: select it, and name it once."""
        return local_table(spark, _literal=self.held).select(self.read("_literal")).scalar()

    def read(self, name: str) -> Column:
        return F.col(name)


class Lookup(Literal):
    """A literal map: an array of buckets by checksum, each a map of a few keys.

    Spark searches a map from its start; a bucket has about one key.
    """

    def __init__(self, values: dict[str, int]):
        self.buckets = 1 << max(len(values) - 1, 1).bit_length()
        held: list[list] = [[] for _ in range(self.buckets)]
        for key, value in values.items():
            held[zlib.crc32(key.encode()) % self.buckets].append((key, value))
        super().__init__(held, pa.list_(pa.map_(pa.string(), pa.int32())))

    def get(self, bound: Column, key: Column) -> Column:
        """The value of a key, or NULL; ``bound`` is the literal as a lambda's variable."""
        bucket = F.pmod(F.crc32(key.cast("binary")), F.lit(self.buckets)).cast("int")
        return F.try_element_at(F.get(bound, bucket), key)


class Pieces(Literal):
    """Bytes by id. Spark joins strings only, and does not look into them."""

    def __init__(self, values: list[bytes]):
        super().__init__(values, pa.list_(pa.binary()))

    def read(self, name: str) -> Column:
        return F.col(name).cast("array<string>")

    @functools.cached_property
    def column(self) -> Column:
        """The same as an expression; it is in the text of the plan, which takes megabytes of the driver."""
        text = json.dumps([v.hex() for v in self.held[0].as_py()], separators=(",", ":"))
        return F.transform(F.from_json(F.lit(text), "array<string>"), lambda x: F.unhex(x).cast("string"))


class Vocabulary:
    """A rank file as literals, with what the fold must know about it."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = Lookup({t.hex().upper(): r for t, r in ranks.items()})
        # Neighbouring bytes of any token: elsewhere a word can be cut.
        pairs = {t[i : i + 2].hex().upper() for t in ranks for i in range(len(t) - 1)}
        self.pairs = Lookup(dict.fromkeys(pairs, 1))
        self.single = Lookup({str(r): 1 for r in _one_at_a_time(ranks)})
        pieces = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            pieces[rank] = token
        self.pieces = Pieces(pieces)
        self.little_endian = Pieces([i.to_bytes(4, "little") for i in range(len(pieces))])

    @staticmethod
    @functools.cache
    def load(name: str = RANKS) -> "Vocabulary":
        """A rank file of the public tokenizers."""
        import public_tokenizers

        with open(public_tokenizers.path(name), "rb") as f:
            return Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


def _one_at_a_time(ranks: dict[bytes, int]) -> list[int]:
    """Ranks whose pairs must be joined one by one, the leftmost first.

    Joining all pairs of a rank at once, of overlapping ones every other from the left, is the
    same as one by one unless a joined piece and its neighbour are a token of lower rank.
    """
    found = set()
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            parts = (ranks.get(token[:i], -1), ranks.get(token[i:], -1))
            if min(parts) >= 0:
                found.update(r for r in parts if r > rank)
    return sorted(found)


class Pattern:
    """The tokenizer's pattern for Java, with letters, numbers and blanks as the tokenizer knows them.

    Java may know fewer of them, those of an older Unicode. The pattern that adds the others is
    slow, so it is used only for texts with characters from the first such one on.
    """

    CLASSES = (r"\p{L}", r"\p{N}", r"\s")
    JAVA = {r"\s": r"\p{IsWhite_Space}"}

    def __init__(self, spark: SparkSession, pattern: str | None = None):
        import public_tokenizers

        self.source = public_tokenizers.PATTERN if pattern is None else pattern
        odd = {name: _difference(spark, name, self.JAVA.get(name, name)) for name in self.CLASSES}
        self.plain = self._written({name: ([], []) for name in odd})
        self.full = self._written(odd)
        self.first = min((p for pair in odd.values() for points in pair for p in points), default=None)

    def _written(self, odd) -> str:
        """The source with each class in Java's notation."""
        inside = {}
        for name, (more, less) in odd.items():
            but = f"&&[^{_ranges(less)}]" if less else ""
            inside[name] = f"[{self.JAVA.get(name, name)}{_ranges(more)}{but}]"
        out = self.source.replace(r"[^\s\p{L}\p{N}]", "[^\0\1\2]").replace(r"\S", "[^\0]")
        for mark, name in zip("\0\1\2", (r"\s", r"\p{L}", r"\p{N}")):
            out = out.replace(name, mark).replace(mark, inside[name])
        return out

    def words(self, text: Column) -> Column:
        """The matches in a text; none in NULL."""
        found = F.regexp_extract_all(text, F.lit(self.plain), F.lit(0))
        if self.first is not None:
            rare = text.rlike(f"[\\x{{{self.first:x}}}-\\x{{10ffff}}]")
            found = F.when(rare, F.regexp_extract_all(text, F.lit(self.full), F.lit(0))).otherwise(found)
        return F.coalesce(found, F.array().cast("array<string>"))


@functools.cache
def _difference(spark: SparkSession, name: str, java: str) -> tuple[list[int], list[int]]:
    """Code points that only the tokenizer, and that only Java, counts to a class."""
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, sys.maxunicode + 1)]))
    # An encoding passes over what its pattern does not match.
    plain = tiktoken.Encoding("class", pat_str=f"{name}+", mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    known = set(map(ord, plain.decode(plain.encode_ordinary(every))))
    points = spark.range(sys.maxunicode + 1).filter("id < 55296 or id > 57343")
    char = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
    held = set(points.filter(char.rlike(f"^[{java}]\\z")).toPandas()["id"])
    return sorted(known - held), sorted(held - known)


def _ranges(points: list[int]) -> str:
    """Code points as ranges of a Java class."""
    out, start = [], None
    for i, p in enumerate(points):
        start = p if start is None else start
        if i + 1 == len(points) or points[i + 1] != p + 1:
            out.append(f"\\x{{{start:x}}}-\\x{{{p:x}}}")
            start = None
    return "".join(out)


def _present(values: Column) -> Column:
    return F.filter(values, lambda x: x.isNotNull())


class _Fold:
    """The fold over one word's bytes, with the literals bound to lambda variables.

    Pieces are kept as the places where they begin, and the end of the word.
    """

    def __init__(self, vocabulary: Vocabulary, ranks: Column, pairs: Column, single: Column):
        self.v, self.ranks, self.pairs, self.single = vocabulary, ranks, pairs, single

    def tokens(self, word: Column) -> Column:
        """The ids of a word."""
        return bind(F.encode(word, "UTF-8"), self._tokens)

    def _tokens(self, data):
        self.data, n = data, F.octet_length(data)

        def whole():
            return self.fold(F.sequence(F.lit(0), n), self.join_first)

        def parts():
            inner = F.filter(F.sequence(F.lit(1), n - 1), lambda i: self.v.pairs.get(self.pairs, self.piece(i - 1, i + 1)).isNull())
            begin, end = F.concat(F.array(F.lit(0)), inner), F.concat(inner, F.array(n))
            # Each part but for its end, where the next one begins.
            folded = F.zip_with(begin, end, lambda a, z: self.fold(F.sequence(a, z), self.join_all))
            return F.concat(F.flatten(F.transform(folded, lambda b: F.slice(b, F.lit(1), F.size(b) - 1))), F.array(n))

        def ids(begin):
            places = F.sequence(F.lit(0), F.size(begin) - 2)
            return F.transform(places, lambda i: self.rank(F.get(begin, i), F.get(begin, i + 1)))

        return bind(F.when(n <= LONG, whole()).otherwise(parts()), ids)

    def piece(self, a: Column, z: Column) -> Column:
        """The bytes from a to z, as they are written in the literals."""
        return F.hex(F.substring(self.data, a + 1, z - a))

    def rank(self, a: Column, z: Column) -> Column:
        return F.coalesce(self.v.ranks.get(self.ranks, self.piece(a, z)), F.lit(_NO_RANK))

    def state(self, begin: Column) -> Column:
        """Places, and the rank of each piece with the one after it."""
        pairs = F.slice(begin, F.lit(1), F.greatest(F.size(begin) - 2, F.lit(0)))
        return F.struct(begin.alias("b"), F.transform(pairs, lambda a, i: self.rank(a, F.get(begin, i + 2))).alias("r"))

    def fold(self, begin: Column, join) -> Column:
        """Join until no two neighbours are a token; the steps that are left over change nothing."""

        def step(s, _):
            # The lowest rank and its first place in one number.
            first = F.array_min(F.transform(s["r"], lambda x, i: F.shiftleft(x.cast("long"), _PLACE) + i))
            done = F.lit(_NO_RANK << _PLACE)
            return bind(F.coalesce(first, done), lambda x: F.when(x >= done, s).otherwise(join(s, x)))

        return bind(begin, lambda b: F.aggregate(b, self.state(b), step, lambda s: s["b"]))

    def join_first(self, s: Column, first: Column) -> Column:
        """Join the first pair of the lowest rank; only its two neighbours get other ranks."""
        b, k = s["b"], _place(first)

        def rank(x, i):
            after = F.when(i == k + 1, self.rank(F.get(b, k), F.get(b, i + 2))).otherwise(F.when(i != k, x))
            return F.when(i == k - 1, self.rank(F.get(b, i), F.get(b, i + 3))).otherwise(after)

        return F.struct(F.filter(b, lambda x, i: i != k + 1).alias("b"), _present(F.transform(s["r"], rank)).alias("r"))

    def join_all(self, s: Column, first: Column) -> Column:
        """Join all pairs of the lowest rank, of overlapping ones every other from the left."""
        b, r, low = s["b"], s["r"], F.shiftright(first, _PLACE).cast("int")

        def edge(side):  # pairs at either end of a run of such pairs
            return _present(F.transform(r, lambda x, i: F.when((x == low) & ~F.coalesce(F.get(r, i + side) == low, F.lit(False)), i)))

        runs = F.zip_with(edge(-1), edge(1), lambda a, z: F.sequence(a, z, F.lit(2)))
        alone = self.v.single.get(self.single, low.cast("string")).isNotNull()
        at = F.when(alone, F.array(_place(first))).otherwise(F.flatten(runs))

        def joined(at):
            from_ = F.concat(F.array(F.lit(0)), F.transform(at, lambda i: i + 2))
            to = F.concat(F.transform(at, lambda i: i + 1), F.array(F.size(b)))
            return F.flatten(F.zip_with(from_, to, lambda a, z: F.slice(b, a + 1, z - a)))

        return bind(bind(at, joined), self.state)


def common_words(texts: DataFrame, pattern: Pattern, most: int = COMMON) -> DataFrame:
    """The commonest distinct words of a column ``text``: word, n. Ties go to the smaller word."""
    found = texts.select(F.explode(pattern.words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return found.filter((F.octet_length("word") <= COMMON_BYTES) & (F.col("n") > 1)).orderBy(F.desc("n"), "word").limit(most)


def encode(
    docs: DataFrame, vocabulary: Vocabulary | None = None, pattern: str | None = None, common: int = COMMON
) -> DataFrame:
    """All rows of ``docs`` with ``ids``, the tokens of their column ``text``; a NULL or empty text has none.

    The other columns come along in ``doc``, so that no name clashes. Rows may repeat; no rows
    give no rows. ``common`` changes nothing but the time it takes.
    """
    v = vocabulary or Vocabulary.load()
    cut = Pattern(docs.sparkSession, pattern)
    doc = F.struct(*[F.col(c) for c in docs.columns if c != "text"]).alias("doc")
    found = cut.words(F.col("text"))
    if not common:
        rows = docs.select(doc, found.alias("_words"))
        return _encode_words(v, rows).select("doc", F.flatten("_ids").alias("ids"))
    # In several tasks, and stored, so that a text's plan holds only their result.
    once = materialize(common_words(docs.select("text"), cut, common)).repartition(TASKS, "word")
    once = _encode_words(v, once.select("word", F.array("word").alias("_words"))).select("word", F.get("_ids", F.lit(0)).alias("ids"))
    rows = docs.select(doc, found.alias("_words"), lookup_value(materialize(once), "word", "ids").alias("_held"))
    return _encode_words(v, rows).select("doc", F.flatten("_ids").alias("ids"))


def _encode_words(v: Vocabulary, rows: DataFrame) -> DataFrame:
    """Add ``_ids``, one array of ids for each word in ``_words``; a column ``_held`` is a lookup of words that are done.

    Each value is named once, so that Spark merges the projections and no row carries it.
    """
    spark, known = rows.sparkSession, "_held" in rows.columns
    values = {"_ranks": v.ranks, "_pairs": v.pairs, "_single": v.single}
    rows = rows.select("*", *[table.scalar(spark).alias(n) for n, table in values.items()])

    def all_words(ranks, pairs, single, held=None):
        fold = _Fold(v, ranks, pairs, single)
        return F.transform("_words", lambda w: fold.tokens(w) if held is None else F.coalesce(find(held, w), fold.tokens(w)))

    def with_ranks(held=None):
        return bind(
            F.col("_ranks"),
            lambda a: bind(F.col("_pairs"), lambda b: bind(F.col("_single"), lambda c: all_words(a, b, c, held))),
        )

    ids = bind(F.col("_held"), with_ranks) if known else with_ranks()
    return rows.select(*[c for c in rows.columns if c not in ("_held", *values)], ids.alias("_ids")).drop("_words")


def with_bytes(encoded: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """Add to rows with ``ids`` their number, and what :func:`little_endian` and :func:`decode` make of them.

    The columns are ``n_tokens``, ``little_endian`` and ``decode``. The literals do not enter the text of the plan.
    """
    v, spark = vocabulary or Vocabulary.load(), encoded.sparkSession
    literals = {"little_endian": v.little_endian, "decode": v.pieces}
    # Each literal is named once, so that Spark merges the last two projections and no row carries it.
    # The ids are named twice, so that they are computed once, before.
    rows = encoded.select("*", F.size("ids").alias("n_tokens"), *[t.scalar(spark).alias(f"_{n}") for n, t in literals.items()])
    joined = [bind(F.col(f"_{n}"), lambda held: _join(F.col("ids"), held)).alias(n) for n in literals]
    return rows.select(*encoded.columns, "n_tokens", *joined)


def little_endian(ids: Column, vocabulary: Vocabulary | None = None) -> Column:
    """Ids as unsigned 32-bit numbers, the lowest byte first: one binary value."""
    return bind((vocabulary or Vocabulary.load()).little_endian.column, lambda held: _join(ids, held))


def decode(ids: Column, vocabulary: Vocabulary | None = None) -> Column:
    """The bytes that an array of ids stands for; an id that is no token stands for none."""
    return bind((vocabulary or Vocabulary.load()).pieces.column, lambda held: _join(ids, held))


def _join(ids: Column, held: Column) -> Column:
    return F.array_join(F.transform(ids, lambda i: F.get(held, i)), "").cast("binary")
