"""Labels, splits and balance.

Every choice depends on a seeded hash of the patient id alone, so it is the same on any
partitioning. Splitting and balancing rank the ids in a narrow table, distributed over
hash ranges, and turn the rank into one cut key per label. Joining labels or splits to the
wide sequence table leaves its rows where they are if the narrow side is small enough to be
broadcast, or if the sequences are stored by patient (``plans.store_sequences``).
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from epistrand.functions.scalars import seeded_key
from epistrand.operators.bloom import prefilter
from epistrand.operators.sequences import min_tokens, once_each
from epistrand.operators.skew import BROADCAST_BYTES, fits_in_broadcast, lookup_join, null_safe_join, running_before
from epistrand.schemas import LABEL_OF_GROUP
from epistrand.sources.store import materialize


def distinct_labels(dx: DataFrame) -> DataFrame:
    """``PATIENT_ID, AIM_GROUP``, each pair once."""
    return dx.select("PATIENT_ID", "AIM_GROUP").distinct()


def recode_label(df: DataFrame, mapping: dict = LABEL_OF_GROUP, column: str = "AIM_GROUP") -> DataFrame:
    """Add ``label``: the number of the group, NULL for a group that has none."""
    if not mapping:
        return df.withColumn("label", F.lit(None).cast("int"))
    cases = None
    for group, label in mapping.items():
        hit = F.col(column) == F.lit(group)
        cases = F.when(hit, F.lit(label)) if cases is None else cases.when(hit, F.lit(label))
    return df.withColumn("label", cases.cast("int"))


def attach_labels(sequences: DataFrame, labels: DataFrame) -> DataFrame:
    """Sequences joined to the label rows (``PATIENT_ID`` and more) of their patient."""
    return _join_narrow(sequences, labels.withColumnRenamed("PATIENT_ID", "patid"))


def _join_narrow(sequences, narrow):
    """Join on the patient; a narrow side that is known to be small is broadcast.

    A larger one is hashed per partition, so that the wide rows stream by and are never sorted.
    """
    small = fits_in_broadcast(narrow)
    return sequences.join(F.broadcast(narrow) if small else narrow.hint("shuffle_hash"), "patid")


def patient_labels(dx: DataFrame, mapping: dict = LABEL_OF_GROUP) -> DataFrame:
    """``PATIENT_ID, label`` for each label a patient has."""
    return recode_label(distinct_labels(dx), mapping).filter(F.col("label").isNotNull()).select("PATIENT_ID", "label")


def conflicting_labels(dx: DataFrame, mapping: dict = LABEL_OF_GROUP) -> DataFrame:
    """``PATIENT_ID, labels``: patients with more than one label."""
    labels = patient_labels(dx, mapping)
    return (
        labels.groupBy("PATIENT_ID")
        .agg(F.array_sort(F.collect_set("label")).alias("labels"))
        .filter(F.size("labels") > 1)
    )


def labelled_cohort(
    sequences: DataFrame, dx: DataFrame, mapping: dict = LABEL_OF_GROUP, conflicts: str = "exclude"
) -> DataFrame:
    """``patid, label`` of the patients with a label and at least two tokens.

    Patients with several labels are left out (see :func:`conflicting_labels`), or kept
    with one row per label if ``conflicts`` is ``"keep"``.
    """
    labels = patient_labels(dx, mapping)
    if conflicts == "exclude":
        labels = (
            labels.groupBy("PATIENT_ID")
            .agg(F.min("label").alias("label"), F.max("label").alias("_high"))
            .filter(F.col("label") == F.col("_high"))
            .drop("_high")
        )
    elif conflicts != "keep":
        raise ValueError("conflicts must be 'exclude' or 'keep'")
    enough = once_each(min_tokens(sequences))
    return attach_labels(enough.select("patid"), labels).select("patid", "label")


def restrict_to(
    df: DataFrame, ids: DataFrame, key: str = "PATIENT_ID", max_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Keep the rows whose patient is in ``ids`` (column ``patid``).

    Ids that cannot be broadcast go through a Bloom filter first, so that rows of other
    patients are left out before anything is shuffled.
    """
    wanted = ids.select(F.col("patid").alias(key)).distinct().withColumn("_wanted", F.lit(True))
    if not fits_in_broadcast(ids, max_bytes):
        df = prefilter(df, key, ids, "patid")
    return lookup_join(df, wanted, key, "inner", max_bytes, bound=ids).select(*df.columns)


def _ranked_keys(ids, seed):
    """``label, _key, _before``: the seeded keys of each label with their rank.

    Keys are ranked within ranges of their hash, so no task sees a whole label.
    """
    keyed = ids.select("label", seeded_key(F.col("patid"), seed).alias("_key"))
    keyed = keyed.withColumn("_range", F.substring("_key", 1, 3))
    return running_before(keyed, ["label"], ["_range"], [F.col("_key")], F.lit(1), "_before").drop("_range")


def test_quotas(ids: DataFrame, test: float) -> DataFrame:
    """``label, quota``: ``ceil(test * n)`` of all rows, shared out over the labels by largest remainder.

    Of equal remainders, the smaller label comes first. The windows are over labels.
    """
    share = F.lit(test) * F.col("_n")
    every = Window.partitionBy(F.lit(0))
    sizes = ids.groupBy("label").agg(F.count("*").alias("_n")).withColumn("_whole", F.floor(share))
    spare = F.ceil(F.lit(test) * F.sum("_n").over(every)) - F.sum("_whole").over(every)
    rank = F.row_number().over(every.orderBy(F.desc(share - F.col("_whole")), "label"))
    return sizes.select("label", (F.col("_whole") + (rank <= spare).cast("long")).alias("quota"))


def stratified_split(df: DataFrame, test: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``split``: ``ceil(test * n)`` patients are ``test``, the others ``train``, with the same share of each label.

    ``df`` has ``patid, label``. Rows without a label are in neither and drop out.
    """
    labelled = df.filter(F.col("label").isNotNull())
    ids = once_each(labelled)
    keyed = _ranked_keys(ids, seed)
    cuts = null_safe_join(keyed, test_quotas(ids, test), ["label"]).filter(F.col("_before") + 1 == F.col("quota"))
    # One row per label; stored, so that its size is known.
    cuts = materialize(cuts.select("label", F.col("_key").alias("cut")))
    joined = lookup_join(labelled, cuts, "label", "left")
    is_test = F.coalesce(seeded_key(F.col("patid"), seed) <= F.col("cut"), F.lit(False))
    split = F.when(is_test, F.lit("test")).otherwise(F.lit("train"))
    return joined.select(*df.columns, split.alias("split"))


def write_splits(sequences: DataFrame, split: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write the labelled sequences under ``path``, one directory per split."""
    split_sequences(sequences, split).write.mode(mode).partitionBy("split").parquet(path)


def split_sequences(sequences: DataFrame, split: DataFrame) -> DataFrame:
    """Sequences with ``label`` and ``split`` of their patient."""
    return _join_narrow(sequences, split.select("patid", "label", "split"))


def undersample(df: DataFrame, seed: int = 42) -> DataFrame:
    """All rows of label 1 and as many of label 0, drawn without replacement.

    ``df`` has ``patid, label``, one sequence per patient. The job fails if there are fewer of label 0.
    """
    ids = once_each(df)
    sizes = ids.agg(F.count_if(F.col("label") == 1).alias("wanted"), F.count_if(F.col("label") == 0).alias("available"))
    wanted, available = sizes.select("wanted").scalar(), sizes.select("available").scalar()
    ranked = _ranked_keys(ids.filter(F.col("label") == 0), seed)
    cut = ranked.filter(F.col("_before") + 1 == wanted).select("_key").scalar()
    message = F.concat(F.lit("cannot draw "), wanted, F.lit(" of "), available, F.lit(" rows of label 0"))
    drawn = F.coalesce(seeded_key(F.col("patid"), seed) <= cut, F.lit(False))
    kept = F.when(wanted > available, F.raise_error(message).cast("boolean")).otherwise((F.col("label") == 1) | drawn)
    return df.filter(F.col("label").isin(0, 1)).filter(kept)


def shuffle(df: DataFrame, seed: int, key: str = "patid") -> DataFrame:
    """Rows in an order that looks random but depends on the seed alone."""
    return df.orderBy(seeded_key(F.col(key), seed))


def sample_patients(df: DataFrame, n: int = 150, seed: int = 42, key: str = "patid") -> DataFrame:
    """``n`` rows without replacement, the same ones every time."""
    return df.orderBy(seeded_key(F.col(key), seed)).limit(n)


def label_distribution(df: DataFrame, *by: str) -> DataFrame:
    """Rows per label: ``label, n``."""
    return once_each(df).groupBy(*by, "label").agg(F.count("*").alias("n"))


def batch_count(df: DataFrame, batch: int = 32) -> DataFrame:
    """``steps``: whole batches in one pass over ``df``."""
    return once_each(df).agg(F.floor(F.count("*") / F.lit(batch)).alias("steps"))


def steps_per_epoch(df: DataFrame, batch: int = 32) -> int:
    """As :func:`batch_count`, as a number."""
    return batch_count(df, batch).first()["steps"]
