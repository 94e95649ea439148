"""Fixed-length training tables from token sequences.

Only the latest ``max_len`` tokens of a sequence matter; they are cut off first. While the
vocabulary is small enough to be broadcast, it is one value of the plan and tokens are looked
up inside the arrays, so that encoding shuffles nothing. Beyond ``max_bytes`` the tokens are
exploded, looked up by a join and collected again; a group then never has more than
``max_len`` tokens, and all columns of a sequence that are not arrays, its keys (``patid``, a
horizon, ...), must identify it: there, equal keys fail the job.

The encoders whose names end in ``_tails`` start from runs of tokens (``sequences.place``)
and cut them before anything is collected, so no array is ever longer than an example.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epistrand.functions.arrays import (
    ages_with_cls,
    attention_mask,
    pad_right,
    parity,
    visit_index,
    with_cls,
)
from epistrand.functions.scalars import age_number, hashed_integer, hashed_uniform
from epistrand.operators.lookup import look_up_all
from epistrand.operators.sequences import collect_tails, latest
from epistrand.operators.skew import BROADCAST_BYTES, fits_in_broadcast, lookup_join, null_safe_join
from epistrand.schemas import MASK, PAD, SEP, SPECIAL_TOKENS, UNK


def _special_id(token):
    """Ids of the special tokens are fixed by ``build_vocab``."""
    return F.lit(SPECIAL_TOKENS.index(token))


def truncate_with_cls(sequences: DataFrame, max_len: int) -> DataFrame:
    """Keep the last ``max_len - 1`` tokens and put CLS in front, or in place of a leading SEP."""
    rows = latest(sequences, max_len - 1)
    return rows.withColumns(
        {"code": with_cls(F.col("code")), "age": ages_with_cls(F.col("code"), F.col("age"))}
    )


def _explode(df, arrays):
    """One row per element: the other columns, ``pos`` and one column per array.

    Rows whose arrays are empty give one row with ``pos`` NULL, so that none is lost.
    """
    others = [c for c in df.columns if c not in arrays]
    zipped = F.arrays_zip(*[F.col(a).alias(a) for a in arrays])
    rows = df.select(*others, F.posexplode_outer(zipped).alias("pos", "_item"))
    return rows.select(*others, "pos", *[F.col(f"_item.{a}").alias(a) for a in arrays]), others


def _collect(rows, others, fields):
    """Collect the fields back into arrays in the order of ``pos``; fails if two rows had the same other columns."""
    item = F.when(F.col("pos").isNotNull(), F.struct("pos", *fields))
    collected = rows.groupBy(*others).agg(F.sort_array(F.collect_list(item)).alias("_items"))
    last = F.coalesce(F.array_max(F.col("_items.pos")), F.lit(-1))
    twice = F.raise_error(F.concat(F.lit("several rows with the same "), F.lit(", ".join(others)))).cast(
        collected.schema["_items"].dataType
    )
    checked = collected.withColumn("_items", F.when(F.size("_items") > last + 1, twice).otherwise(F.col("_items")))
    return checked.select(*others, *[F.col(f"_items.{f}").alias(f) for f in fields])


def _look_up(rows, vocab, column, out, max_bytes):
    """Left join of a token column to its ids; unknown tokens give NULL."""
    ids = vocab.select(F.col("token").alias(column), F.col("idx").alias(out))
    return lookup_join(rows, ids, column, "left", max_bytes)


def tokens_to_ids(
    df: DataFrame, vocab: DataFrame, column: str = "code", out: str | None = None,
    mask_token: str | None = None, unknown: bool = True, max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Replace an array of tokens by the array of their ids (written to ``out`` if given).

    A token that is not in the vocabulary becomes UNK, or NULL if ``unknown`` is false.
    Tokens equal to ``mask_token`` become UNK.
    """
    target = out or column

    def settle(token, idx):
        idx = F.coalesce(idx, _special_id(UNK)) if unknown else idx
        return idx if mask_token is None else F.when(token == F.lit(mask_token), _special_id(UNK)).otherwise(idx)

    if fits_in_broadcast(vocab, max_bytes):
        return look_up_all(df, column, vocab, target, settle)
    source = df if target == column else df.withColumn(target, F.col(column))
    rows, others = _explode(source, [target])
    rows = _look_up(rows, vocab, target, "_id", max_bytes)
    encoded = _collect(rows.withColumn(target, settle(F.col(target), F.col("_id"))), others, [target])
    return encoded.select(*source.columns)


def pad_to_ids(
    df: DataFrame, vocab: DataFrame, max_len: int, column: str = "code", symbol: str = PAD, unknown: bool = True,
    max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Pad a token column to ``max_len`` and look up the ids of tokens and padding."""
    padded = df.withColumn(column, pad_right(F.col(column), max_len, symbol))
    return tokens_to_ids(padded, vocab, column, unknown=unknown, max_bytes=max_bytes)


def mask_columns(code_id, patid, pos, seed, vocab_size):
    """Masked input id and label of one token.

    15% of the tokens are chosen: of those 80% become MASK, 10% any id of the vocabulary,
    10% stay. The label is the true id of a chosen token, else -1.
    """
    u = hashed_uniform(patid, pos, F.lit(seed))
    # Drawn from a second hash, so that it does not depend on the choice above.
    any_id = F.pmod(hashed_integer(patid, pos, F.lit(seed), F.lit("id")), vocab_size).cast("int")
    share = u / F.lit(0.15)
    masked = (
        F.when(u >= 0.15, code_id)
        .when(share < 0.8, _special_id(MASK))
        .when(share < 0.9, any_id)
        .otherwise(code_id)
    )
    return masked, F.when(u < 0.15, code_id).otherwise(F.lit(-1))


def mlm_mask(df: DataFrame, vocab: DataFrame, seed: int = 42, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Random masking of a token column: ``code`` becomes masked ids, ``label`` the ids to predict.

    ``df`` has ``patid`` and ``code``. What is masked depends on the patient, the position in
    the whole sequence (``start`` of a segment and the place in it) and the seed alone.
    """
    rows = tokens_to_ids(df.drop("label"), vocab, max_bytes=max_bytes)
    first = F.col("start") if "start" in df.columns else F.lit(0)
    others = [c for c in rows.columns if c != "code"]
    masked = _masked(rows, "code", vocab, seed, first)
    return masked.select(*others, F.col("masked_id").alias("code"), "label")


def _masked(rows, ids, vocab, seed, first):
    """Add ``masked_id`` and ``label`` for an array of ids whose first one stands at ``first`` in the sequence."""
    size = vocab.agg(F.count("*").alias("_size")).scalar()

    def token(code_id, i):
        masked, label = mask_columns(code_id, F.col("patid"), i + first, seed, F.col("_size"))
        return F.struct(masked.alias("masked_id"), label.alias("label"))

    items = rows.withColumn("_size", size).withColumn("_items", F.transform(ids, token))
    return items.withColumns({c: F.col(f"_items.{c}") for c in ("masked_id", "label")}).drop("_items", "_size")


def _known(rows, vocab, ages, max_bytes):
    """Arrays ``code_id, age_id, is_sep`` in place of ``code, age``; unknown tokens become UNK."""
    others = [c for c in rows.columns if c not in ("code", "age")]
    if fits_in_broadcast(vocab, max_bytes):
        unknown_age = ages.filter(F.col("token") == UNK).select("idx").scalar().alias("_unknown")
        found = look_up_all(rows, "code", vocab, "code_id", lambda t, i: F.coalesce(i, _special_id(UNK)))
        found = look_up_all(found.select("*", unknown_age), "age", ages, "age_id", lambda t, i: F.coalesce(i, F.col("_unknown")))
        return found.select(*others, "code_id", "age_id", F.transform("code", _is_sep).alias("is_sep"))
    long, others = _explode(rows, ["code", "age"])
    long = _look_up(_look_up(long, vocab, "code", "code_id", max_bytes), ages, "age", "age_id", max_bytes)
    unknown_age = ages.filter(F.col("token") == UNK).select("idx").scalar()
    long = long.withColumns(
        {
            "code_id": F.coalesce("code_id", _special_id(UNK)),
            "age_id": F.coalesce("age_id", unknown_age),
            "is_sep": _is_sep(F.col("code")),
        }
    )
    return _collect(long, others, ["code_id", "age_id", "is_sep"])


def _is_sep(code):
    return F.coalesce(code == F.lit(SEP), F.lit(False))


def _fixed_length(rows, max_len, ages, code, others):
    """Pad all arrays; positions keep counting through the padding."""
    pad_age = ages.filter(F.col("token") == PAD).select("idx").scalar()
    marks = pad_right(F.col("is_sep"), max_len, False)
    rows = rows.withColumn("position", visit_index(marks))
    return rows.select(
        *others,
        pad_right(F.col("age_id"), max_len, pad_age).alias("age"),
        pad_right(F.col(code), max_len, _special_id(PAD)).alias("code"),
        "position",
        parity(F.col("position")).alias("segment"),
        attention_mask(F.col("code_id"), max_len).alias("mask"),
        *([pad_right(F.col("label"), max_len, -1).alias("label")] if "label" in rows.columns else []),
    )


def _identity(sequences):
    """Sequences without the columns that are only about their length."""
    return sequences.drop("n_tokens", "n_visits")


def _keys(sequences, *arrays):
    """The columns that identify a sequence."""
    return [c for c in _identity(sequences).columns if c not in ("start", "visit", "code", "age", *arrays)]


def encode_mlm(
    sequences: DataFrame, vocab: DataFrame, ages: DataFrame, max_len: int = 300, seed: int = 42,
    max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Masked-token examples: the keys of the sequence and ``age, code, position, segment, mask, label``.

    A column ``label`` of the sequences is not among the keys.
    """
    keys = _keys(sequences, "label")
    cut = truncate_with_cls(sequences, max_len).select(*keys, "code", "age")
    rows = _masked(_known(cut, vocab, ages, max_bytes), "code_id", vocab, seed, F.lit(0))
    return _fixed_length(rows, max_len, ages, "masked_id", keys)


def encode_mlm_tails(
    runs: DataFrame, keys: list[str], vocab: DataFrame, ages: DataFrame, max_len: int = 300, seed: int = 42,
    max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """:func:`encode_mlm` from runs of tokens."""
    return encode_mlm(collect_tails(runs, keys, max_len - 1), vocab, ages, max_len, seed, max_bytes)


def encode_next_visit(
    sequences: DataFrame, vocab: DataFrame, label_vocab: DataFrame, ages: DataFrame, max_len: int,
    max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Next-visit examples: as :func:`encode_mlm` without masking.

    ``sequences`` has ``label``, an array of tokens, encoded with its own vocabulary and
    padded with -1.
    """
    keys = _keys(sequences, "label")
    cut = truncate_with_cls(sequences, max_len).select(*keys, "code", "age", "label")
    padded = pad_right(F.col("label"), max_len, -1)
    if fits_in_broadcast(label_vocab, max_bytes) and fits_in_broadcast(vocab, max_bytes):
        rows = tokens_to_ids(cut, label_vocab, "label", max_bytes=max_bytes).withColumn("label", padded)
        return _fixed_length(_known(rows, vocab, ages, max_bytes), max_len, ages, "code_id", keys)
    rows = _known(cut.select(*keys, "code", "age"), vocab, ages, max_bytes)
    inputs = _fixed_length(rows, max_len, ages, "code_id", keys)
    labels = tokens_to_ids(cut.select(*keys, "label"), label_vocab, "label", max_bytes=max_bytes)
    return null_safe_join(inputs, labels.select(*keys, padded.alias("label")), keys)


def encode_classifier(
    sequences: DataFrame, vocab: DataFrame, max_len: int = 300, max_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Classifier examples: ``input_ids, age_ids, seg_ids, attention_mask`` and the other columns.

    The last ``max_len`` tokens, no CLS. Unknown tokens are 0, ages are plain numbers up to
    1321, padding is 0 throughout.
    """
    rows = _identity(latest(sequences, max_len))
    if "age" not in rows.columns:
        rows = rows.withColumn("age", F.array_repeat(F.lit("0"), F.size("code")))
    limits = vocab.agg(
        (F.count("*") - 1).cast("int").alias("top"),
        F.coalesce(F.max(F.when(F.col("token") == SEP, F.col("idx"))), F.lit(0)).alias("sep"),
    )
    top, sep = limits.select("top").scalar(), limits.select("sep").scalar()
    others = [c for c in rows.columns if c not in ("code", "age")]
    if fits_in_broadcast(vocab, max_bytes):
        found = look_up_all(rows, "code", vocab, "_id").withColumn("age_ids", F.transform("age", lambda a: age_number(a)))
    else:
        long, others = _explode(rows, ["code", "age"])
        long = _look_up(long, vocab, "code", "_id", max_bytes).withColumn("age_ids", age_number(F.col("age")))
        found = _collect(long, others, ["_id", "age_ids"])
    found = found.select("*", top.alias("_top"), sep.alias("_sep"))
    known = F.transform("_id", lambda i: F.least(F.coalesce(i, F.lit(0)), F.col("_top")))
    encoded = found.withColumn("input_ids", known)
    marks = F.transform("input_ids", lambda i: i == F.col("_sep"))
    return encoded.select(
        *others,
        pad_right(F.col("input_ids"), max_len, 0).alias("input_ids"),
        pad_right(F.col("age_ids"), max_len, 0).alias("age_ids"),
        pad_right(parity(visit_index(marks)), max_len, 0).alias("seg_ids"),
        attention_mask(F.col("input_ids"), max_len).alias("attention_mask"),
    )


def encode_classifier_tails(
    runs: DataFrame, keys: list[str], vocab: DataFrame, max_len: int = 300, max_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """:func:`encode_classifier` from runs of tokens."""
    return encode_classifier(collect_tails(runs, keys, max_len), vocab, max_len, max_bytes)


def aligned_tokens(sequences: DataFrame, max_len: int) -> DataFrame:
    """The tokens that :func:`encode_classifier` sees, as text, padded with PAD."""
    rows = _identity(latest(sequences, max_len))
    others = [c for c in rows.columns if c not in ("code", "age")]
    return rows.select(*others, pad_right(F.col("code"), max_len, PAD).alias("code"))


def attributions_by_code(sequences: DataFrame, values: DataFrame, max_len: int) -> DataFrame:
    """The keys and ``pos, code, value`` from one row of attribution values per sequence.

    ``values`` has ``values``, an array with one array of hidden-axis values per position,
    which are summed, and those key columns of ``sequences`` that it refers to; it is joined
    on all columns that both have.
    """
    keys = [c for c in _keys(sequences) if c in values.columns]
    tokens = null_safe_join(aligned_tokens(sequences, max_len).select(*keys, "code"), values.select(*keys, "values"), keys)
    rows = tokens.select(*keys, F.posexplode(F.arrays_zip("code", "values")).alias("pos", "_item"))
    total = F.aggregate("_item.values", F.lit(0.0), lambda acc, x: acc + x)
    return rows.select(*keys, "pos", F.col("_item.code").alias("code"), total.alias("value"))
