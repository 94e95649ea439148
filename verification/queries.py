"""One query per operator over the test tables.

Arrays are emitted as text, so that they can be compared with SQL results.
"""

import functools

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epistrand.functions import arrays as A
from epistrand.functions.scalars import event_kind
from epistrand.operators import audit, censor, cohort, distinct, encode, evaluate, events, normalize, sequences, vocab
from epistrand.plans import horizon_test_sets, patient_runs, patient_sequences, store_sequences
from epistrand.sources import join_segments, materialize
from verification import io
from verification.views import THRESHOLDS, Views

# Codes that the leakage reports look for.
FLAGGED = ["DX:ICD10CM:Brand#13", "DX:ICD10CM:Brand#7"]
SEED = 42
CANONICAL = tuple(THRESHOLDS)
TOKENS = 64  # length of the masked-token and next-visit examples
CLASSIFIER_TOKENS = 300
MAX_AGE = 110
SEGMENT = 7  # tokens per segment, in the queries that cut sequences


class Inputs:
    """What the queries start from; tables that many of them need are computed once per session."""

    _shared: dict = {}

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.views = spark, Views(spark, sf_dir)
        self._key = (spark.sparkContext.applicationId, sf_dir)

    @classmethod
    def forget(cls):
        cls._shared.clear()

    def _once(self, name, make) -> DataFrame:
        tables = self._shared.setdefault(self._key, {})
        if name not in tables:
            tables[name] = materialize(make())
        return tables[name]

    dx = property(lambda self: self.views.deid_visit_dx)
    labs = property(lambda self: self.views.deid_lab_out)
    vitals = property(lambda self: self.views.deid_vital)
    # The smaller tables are stored, as inputs are, so that their sizes are known.
    demo = property(lambda self: self._once("demo", lambda: self.views.deid_dem))
    index = property(lambda self: self._once("index", lambda: self.views.earliest_dx_deid))
    crosswalk = property(lambda self: self._once("crosswalk", lambda: self.views.dpi_lab_map))
    preds = property(lambda self: self.views.predictions)
    gappy_preds = property(lambda self: self.views.gappy_predictions)

    @property
    def measurements(self):
        return normalize.union_measurements(
            normalize.labs_to_measurements(self.labs), normalize.vitals_to_measurements(self.vitals)
        )

    @property
    def named(self):
        return normalize.normalize_names(
            normalize.with_value(self.measurements), normalize.synonym_map(self.crosswalk, CANONICAL), bound=self.crosswalk
        )

    @property
    def raw_events(self):
        lab_events = normalize.discretize(self.labs, self.vitals, self.crosswalk, THRESHOLDS)
        return events.universal_events(events.events_from_dx(self.dx), lab_events)

    @property
    def events(self):
        return self._once("events", lambda: self.raw_events)

    @property
    def censored(self):
        return censor.censor_at_index(self.events, self.index)

    @property
    def aged(self):
        return events.add_age(self.censored, self.demo)

    @property
    def seqs(self):
        return self._once("seqs", lambda: patient_sequences(self.events, self.index, self.demo))

    @property
    def runs(self):
        return patient_runs(self.events, self.index, self.demo)

    @property
    def segments(self):
        return self._once("segments", lambda: patient_sequences(self.events, self.index, self.demo, SEGMENT))

    @property
    def cohort(self):
        return self._once("cohort", lambda: cohort.labelled_cohort(self.seqs, self.dx))

    @property
    def split(self):
        return self._once("split", lambda: cohort.stratified_split(self.cohort, seed=SEED))

    @property
    def test(self):
        return self.split.filter(F.col("split") == "test").select("patid", "label")

    @property
    def references(self):
        return censor.reference_dates(self.test, self.index, self.test_events)

    @property
    def test_events(self):
        return cohort.restrict_to(self.censored, self.test)

    @property
    def horizons(self):
        return horizon_test_sets(self.censored, self.demo, self.index, self.test)

    @property
    def vocab(self):
        return self._once("vocab", lambda: vocab.build_vocab(self.seqs))

    @property
    def ages(self):
        return vocab.age_vocab(self.spark, MAX_AGE)

    @property
    def next_visits(self):
        """Sequences with a label list: their last three tokens."""
        return self.seqs.withColumn("label", A.tail(F.col("code"), 3))

    @property
    def label_vocab(self):
        return self._once("label_vocab", lambda: vocab.build_vocab(self.next_visits, "label"))

    @property
    def step_log(self):
        """The training log as ten epochs with a precision column."""
        return self.views.training_log.select(
            F.pmod("run_id", F.lit(10)).cast("int").alias("epoch"), "cnt", "loss",
            (F.col("loss") / 100).alias("precision"),
        )


def text(column, separator="|"):
    return F.array_join(F.col(column).cast("array<string>"), separator).alias(column)


def _sequence_text(seqs, *keys):
    return seqs.select(*keys, "n_tokens", text("code"), text("age"))


def _numbers(df, keys, columns):
    return df.select(*keys, *[text(c, ",") for c in columns])


def _rounded(df, keys, columns, digits=9):
    return df.select(*keys, *[F.round(F.col(c), digits).alias(c) for c in columns])


def _busiest(rows):
    """The patient with most rows, as a scalar subquery."""
    counts = rows.groupBy("PATIENT_ID").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "PATIENT_ID").limit(1).select("PATIENT_ID").scalar()


def _bin_values(i):
    known = normalize.keep_known_tests(i.named, THRESHOLDS)
    return normalize.bin_values(known, THRESHOLDS)


def _masked_scores(i):
    """Three scores and a label per order line; returned lines have no label."""
    scores = F.array("l_discount", "l_tax", F.col("l_quantity") / 500)
    label = F.when(F.col("l_returnflag") == "R", F.lit(-1)).otherwise(F.pmod("l_linenumber", F.lit(3)))
    return i.views.table("lineitem").select(label.cast("int").alias("label"), scores.alias("scores"))


def _score(i):
    def scorer():
        return lambda batch: np.stack(batch["attention_mask"]).sum(axis=1) / 100.0 - 0.75

    return evaluate.score(_classifier(i), scorer, ["patid", "label"])


def _classifier(i):
    labelled = cohort.split_sequences(i.seqs, i.split)
    return encode.encode_classifier(labelled.drop("split"), i.vocab, CLASSIFIER_TOKENS)


def _distinct_by_kind(i):
    """Patients with each kind of event, exactly, and whether the merged sketches of months are as near as stated."""
    kinds = i.events.select(event_kind(F.col("CODE")).alias("kind"), F.trunc("DATE", "MM").alias("month"), "PATIENT_ID")
    sketches = materialize(distinct.sketch_distinct(kinds, ["kind", "month"], "PATIENT_ID"))
    both = distinct.count_distinct(kinds, ["kind"], "PATIENT_ID").join(distinct.estimate_distinct(sketches, ["kind"]), "kind")
    near = F.abs(F.col("estimate") - F.col("n")) <= F.col("n") * F.lit(distinct.error_bound())
    return both.select("kind", "n", near.cast("int").alias("is_near"))


def _classifier_tails(i):
    """Examples from runs; the labels join what is then short."""
    examples = encode.encode_classifier_tails(i.runs, ["PATIENT_ID"], i.vocab, CLASSIFIER_TOKENS)
    return cohort.split_sequences(examples, i.split)


def _mlm_tails(i):
    runs = i.runs.filter(F.col("n_visits") >= 5)
    return encode.encode_mlm_tails(runs, ["PATIENT_ID"], i.vocab, i.ages, TOKENS, SEED)


def _mlm_mask(i):
    rows = encode.mlm_mask(i.seqs.select("patid", "code"), i.vocab, SEED)
    return _numbers(rows, ["patid"], ["code", "label"])


def _mlm_mask_segments(i):
    rows = encode.mlm_mask(i.segments.select("patid", "start", "code"), i.vocab, SEED)
    return _numbers(rows, ["patid", "start"], ["code", "label"])


def _index_arrays(i):
    return i.seqs.select(
        "patid",
        A.position_index(F.col("code")).alias("position"),
        A.segment_index(F.col("code")).alias("segment"),
        A.attention_mask(F.col("code"), CLASSIFIER_TOKENS).alias("mask"),
    )


def _index_arrays_segments(i):
    return i.segments.select(
        "patid", "start",
        A.position_index(F.col("code"), before=F.col("visit")).alias("position"),
        A.segment_index(F.col("code"), before=F.col("visit")).alias("segment"),
    )


def _attributions_by_horizon(i):
    """Two hidden-axis values per position, told apart by horizon; each horizon has its own."""
    places = F.sequence(F.lit(1), F.lit(ATTRIBUTED))
    values = F.transform(places, lambda p: F.array(p * F.col("years") * F.lit(0.25), F.lit(-0.5)))
    sets = i.horizons
    found = encode.attributions_by_code(sets, sets.select("years", "patid", values.alias("values")), ATTRIBUTED)
    return found.select("years", "patid", "pos", "code", "value")


ATTRIBUTED = 12


EXAMPLE = ["age", "code", "position", "segment", "mask", "label"]

QUERIES = {
    # Projections and filters
    "events_from_dx": lambda i: events.events_from_dx(i.dx),
    "labs_to_measurements": lambda i: normalize.labs_to_measurements(i.labs),
    "vitals_to_measurements": lambda i: normalize.vitals_to_measurements(i.vitals),
    "measurements_with_value": lambda i: normalize.with_value(i.measurements),
    "keep_known_tests": lambda i: normalize.keep_known_tests(i.named, THRESHOLDS),
    "recode_label": lambda i: cohort.recode_label(i.dx),
    "min_tokens": lambda i: sequences.min_tokens(i.seqs, 40).select("patid", "n_tokens"),
    "min_tokens_segments": lambda i: sequences.once_each(sequences.min_tokens(i.segments, 40)).select("patid", "n_tokens"),
    "min_visits": lambda i: sequences.min_visits(i.seqs).select("patid", "n_visits"),
    "visit_filter_report": lambda i: sequences.visit_filter_report(i.seqs),
    "patient_events": lambda i: events.patient_events(i.events, _busiest(i.events)),
    "events_with_codes": lambda i: events.events_with_codes(i.events, FLAGGED),
    # Joins and ages
    "last_visit": lambda i: events.last_visit(i.censored),
    "year_of_birth": lambda i: events.year_of_birth(i.censored, i.demo),
    "add_age": lambda i: events.add_age(i.censored, i.demo),
    "attach_labels": lambda i: cohort.attach_labels(
        i.seqs.select("patid", "n_tokens"), cohort.distinct_labels(i.dx)
    ),
    "restrict_to": lambda i: cohort.restrict_to(i.censored, i.test),
    # As if the ids were too many to be broadcast.
    "restrict_to_filtered": lambda i: cohort.restrict_to(i.censored, i.test, max_bytes=-1),
    # Normalisation and binning
    "synonym_map": lambda i: normalize.synonym_map(i.crosswalk, CANONICAL),
    "ambiguous_names": lambda i: normalize.ambiguous_names(i.crosswalk, CANONICAL).select("name", text("loincs")),
    "normalize_names": lambda i: i.named,
    "bin_values": _bin_values,
    "discretize": lambda i: normalize.discretize(i.labs, i.vitals, i.crosswalk, THRESHOLDS),
    "universal_events": lambda i: i.raw_events,
    # Censoring
    "earliest_index": lambda i: censor.earliest_index(i.index),
    "censor_at_index": lambda i: censor.censor_at_index(i.events, i.index),
    "censor_any_row": lambda i: censor.censor_at_index(i.events, i.index, mode="any_row"),
    "reference_dates": lambda i: i.references,
    "censor_at_horizon": lambda i: censor.censor_at_horizon(i.test_events, i.references),
    "horizon_test_sets": lambda i: _sequence_text(i.horizons, "years", "patid", "label"),
    "horizon_report": lambda i: audit.horizon_report(i.horizons, i.test),
    "reference_disagreements": lambda i: audit.reference_disagreements(i.references, i.test),
    # Visits and sequences
    "patient_sequences": lambda i: _sequence_text(patient_sequences(i.raw_events, i.index, i.demo), "patid"),
    "patient_sequences_segments": lambda i: i.segments.select(
        "patid", "start", "visit", "n_tokens", "n_visits", text("code"), text("age")
    ),
    "build_visits": lambda i: _sequence_text(sequences.build_visits(i.aged), "PATIENT_ID", "DATE"),
    "build_sequences": lambda i: _sequence_text(sequences.build_sequences(i.aged), "patid"),
    "sequence_summary": lambda i: _rounded(
        sequences.sequence_summary(i.seqs), ["n_patients", "max_seq_len"], ["avg_seq_len"]
    ),
    "longest_sequences": lambda i: sequences.longest_sequences(i.seqs),
    # Cohorts
    "distinct_labels": lambda i: cohort.distinct_labels(i.dx),
    "labelled_cohort": lambda i: cohort.labelled_cohort(i.seqs, i.dx),
    "cohort_conflicts": lambda i: cohort.conflicting_labels(i.dx).select("PATIENT_ID", text("labels", ",")),
    "labelled_cohort_keep": lambda i: cohort.labelled_cohort(i.seqs, i.dx, conflicts="keep"),
    "conflicting_labels": lambda i: cohort.conflicting_labels(
        # Whole groups of customers per nation as patients, so that labels do conflict.
        i.views.table("customer").select(
            F.col("c_nationkey").cast("string").alias("PATIENT_ID"),
            F.when(F.col("c_mktsegment") == "MACHINERY", "2_Type2").otherwise("1_NoD").alias("AIM_GROUP"),
        )
    ).select("PATIENT_ID", text("labels", ",")),
    "stratified_split": lambda i: cohort.stratified_split(cohort.labelled_cohort(i.seqs, i.dx), seed=SEED),
    "split_sequences": lambda i: _sequence_text(
        cohort.split_sequences(i.seqs, i.split), "patid", "label", "split"
    ),
    "split_sequences_stored": lambda i: _sequence_text(
        cohort.split_sequences(store_sequences(i.runs, io.BUCKETS), i.split), "patid", "label", "split"
    ),
    "join_segments": lambda i: _sequence_text(join_segments(i.segments), "patid"),
    "write_splits": lambda i: _sequence_text(io.written_splits(i.seqs, i.split), "patid", "label", "split"),
    "undersample": lambda i: cohort.undersample(i.cohort, SEED),
    "shuffle": lambda i: cohort.shuffle(i.cohort, SEED),
    "sample_patients": lambda i: cohort.sample_patients(i.cohort, 150, SEED),
    "label_distribution": lambda i: cohort.label_distribution(i.split, "split"),
    "batch_count": lambda i: cohort.batch_count(i.cohort),
    # Vocabulary and encoding
    "build_vocab": lambda i: vocab.build_vocab(i.seqs),
    "invert_vocab": lambda i: vocab.invert_vocab(i.vocab),
    "truncate_with_cls": lambda i: encode.truncate_with_cls(i.seqs, TOKENS).select("patid", text("code"), text("age")),
    "index_arrays": lambda i: _numbers(_index_arrays(i), ["patid"], ["position", "segment", "mask"]),
    "index_arrays_segments": lambda i: _numbers(_index_arrays_segments(i), ["patid", "start"], ["position", "segment"]),
    "tokens_to_ids": lambda i: _numbers(
        encode.tokens_to_ids(i.seqs.select("patid", "code"), i.vocab, mask_token="SEP"), ["patid"], ["code"]
    ),
    "pad_to_ids": lambda i: _numbers(
        encode.pad_to_ids(i.seqs.select("patid", "age"), i.ages, TOKENS, "age"), ["patid"], ["age"]
    ),
    "mlm_mask": _mlm_mask,
    "mlm_mask_segments": _mlm_mask_segments,
    "encode_mlm": lambda i: _numbers(
        encode.encode_mlm(sequences.min_visits(i.seqs), i.vocab, i.ages, TOKENS, SEED), ["patid"], EXAMPLE
    ),
    "encode_mlm_segments": lambda i: _numbers(
        encode.encode_mlm(sequences.min_visits(i.segments), i.vocab, i.ages, TOKENS, SEED), ["patid"], EXAMPLE
    ),
    "encode_mlm_horizons": lambda i: _numbers(
        encode.encode_mlm(i.horizons, i.vocab, i.ages, TOKENS, SEED), ["years", "patid"], EXAMPLE
    ),
    "encode_next_visit": lambda i: _numbers(
        encode.encode_next_visit(i.next_visits, i.vocab, i.label_vocab, i.ages, TOKENS), ["patid"], EXAMPLE
    ),
    "encode_classifier": lambda i: _numbers(
        _classifier(i), ["patid", "label"], ["input_ids", "age_ids", "seg_ids", "attention_mask"]
    ),
    "encode_mlm_tails": lambda i: _numbers(_mlm_tails(i), ["patid"], EXAMPLE),
    "encode_classifier_tails": lambda i: _numbers(
        _classifier_tails(i), ["patid", "label"], ["input_ids", "age_ids", "seg_ids", "attention_mask"]
    ),
    "aligned_tokens": lambda i: encode.aligned_tokens(i.seqs, TOKENS).select("patid", text("code")),
    # Evaluation
    "confusion": lambda i: evaluate.confusion(i.preds),
    "binary_metrics": lambda i: _rounded(
        evaluate.binary_metrics(i.preds), ["horizon"], ["precision", "recall", "f1", "specificity"]
    ),
    "roc_auc": lambda i: _rounded(evaluate.roc_auc(i.preds), ["horizon"], ["roc_auc"]),
    # Groups of four orders, many of which have one class only.
    "roc_auc_gaps": lambda i: _rounded(evaluate.roc_auc(i.gappy_preds), ["horizon"], ["roc_auc"]),
    "metrics_gaps": lambda i: _rounded(
        evaluate.metrics_by_horizon(i.gappy_preds),
        ["horizon", "n_patients", "n_cases", "n_controls"],
        ["roc_auc", "f1", "precision", "recall", "specificity"],
    ),
    "single_class_groups": lambda i: evaluate.single_class_groups(
        i.preds.withColumn("horizon", F.floor(F.col("patid").cast("bigint") / 4))
    ),
    "metrics_by_horizon": lambda i: _rounded(
        evaluate.metrics_by_horizon(i.preds),
        ["horizon", "n_patients", "n_cases", "n_controls"],
        ["roc_auc", "f1", "precision", "recall", "specificity"],
    ),
    # Rounded to single precision: the values have few decimals, so decimal rounding would meet ties.
    "smooth": lambda i: evaluate.smooth(i.views.training_log, "run_id", "cnt", "loss").select(
        "run_id", "cnt", F.col("smoothed").cast("float").cast("double").alias("smoothed")
    ),
    "smooth_gaps": lambda i: evaluate.smooth(i.views.gappy_log, "run_id", "cnt", "loss").select(
        "run_id", "cnt", F.when(~F.isnan("smoothed"), F.col("smoothed").cast("float").cast("double")).alias("smoothed")
    ),
    "masked_precision": lambda i: _rounded(evaluate.masked_precision(_masked_scores(i)), [], ["precision"]),
    "global_steps": lambda i: evaluate.global_steps(i.step_log, 1000).select("epoch", "cnt", "global_step", "loss"),
    "epoch_precision": lambda i: _rounded(evaluate.epoch_precision(i.step_log), ["epoch"], ["precision"]),
    "attribution_summary": lambda i: _rounded(
        evaluate.attribution_summary(i.views.attributions), ["code", "n_occurrences"], ["mean_shap", "mean_abs_shap"]
    ),
    "attributions_by_horizon": _attributions_by_horizon,
    "top_attributions": lambda i: _rounded(
        evaluate.top_attributions(evaluate.attribution_summary(i.views.attributions)),
        ["code", "n_occurrences"], ["mean_shap", "mean_abs_shap"],
    ),
    "score": lambda i: _rounded(_score(i), ["patid", "label", "pred"], ["prob"]),
    # Reports
    "bin_summary": lambda i: audit.bin_summary(
        normalize.discretize(i.labs, i.vitals, i.crosswalk, THRESHOLDS)
    ),
    "event_kind_summary": lambda i: audit.event_kind_summary(i.censored),
    "distinct_by_kind": _distinct_by_kind,
    "patient_profile": lambda i: audit.patient_profile(i.censored),
    "top_days": lambda i: audit.top_days(i.censored),
    "top_codes": lambda i: audit.top_codes(i.censored),
    "top_codes_of_patient": lambda i: audit.top_codes(i.censored, _busiest(i.censored)),
    "leakage_audit": lambda i: audit.leakage_audit(i.censored, FLAGGED),
    "audit_examples": lambda i: audit.audit_examples(i.censored, FLAGGED),
    "leakage_examples": lambda i: audit.leakage_examples(i.censored, i.index, FLAGGED),
    "patients_with_events": lambda i: audit.patients_with_events(i.test_events),
    "sort_events": lambda i: events.sort_events(i.censored),
    # Sources and sinks: written to the checkpoint folder and read again
    **{name: functools.partial(lambda make, i: make(i.views), make) for name, make in io.QUERIES.items()},
}


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES[name](Inputs(spark, sf_dir))
