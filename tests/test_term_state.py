"""Vocabularies from bucket bounds and from counts that grow."""

import numpy as np
import pytest
from comparing import rows
from pyspark.sql import functions as F

from candor.operators import tfidf
from candor.operators.term_state import TermState
from candor.operators.tfidf import TextFeatures
from catalog import tables as t


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    from candor.sources.staging import stage

    return stage(t.tokens(spark, sf_dir), "test-tokens")


SPECS = [TextFeatures(50), TextFeatures(300, (1, 2), 2, 0.9, ("the", "der"), True), TextFeatures(10**6, (1, 2))]


def full(docs, spec):
    return tfidf.chosen_terms(tfidf.corpus_term_counts(docs, spec.terms("tokens")), docs.count(), spec)


@pytest.mark.parametrize("spec", SPECS)
@pytest.mark.parametrize("buckets, per_term", [(1 << 18, 4), (1 << 18, 1), (256, 4)])
def test_heavy_buckets_give_the_whole_choice(docs, monkeypatch, spec, buckets, per_term):
    """Also with few buckets, where most terms share theirs, and with a first bound that is too high."""
    monkeypatch.setattr(tfidf, "TERM_BUCKETS", buckets)
    monkeypatch.setattr(tfidf, "BUCKETS_PER_TERM", per_term)
    assert tfidf.fit_terms(docs, "tokens", spec).equals(full(docs, spec))


def test_second_count_is_final_if_the_first_bound_fails(docs, monkeypatch):
    spec, tried = TextFeatures(200, min_df=5), []
    totals = tfidf.bucket_totals(docs, spec.terms("tokens"))
    monkeypatch.setattr(tfidf, "BUCKETS_PER_TERM", 1)
    inside = tfidf.in_buckets
    monkeypatch.setattr(tfidf, "in_buckets", lambda terms, chosen: tried.append(chosen.sum()) or inside(terms, chosen))
    got = tfidf.top_terms(docs, spec.terms("tokens"), docs.count(), spec, totals)
    assert got.equals(full(docs, spec)) and len(tried) <= 2


def test_totals_bound_counts_and_few_terms_are_counted(docs):
    spec = TextFeatures(100, (1, 2))
    terms = spec.terms("tokens")
    totals = tfidf.bucket_totals(docs, terms)
    counted = tfidf.corpus_term_counts(docs, terms).select("tf", tfidf.term_bucket(F.col("term")).alias("b")).toPandas()
    assert (counted["tf"].to_numpy() <= totals[counted["b"].to_numpy()]).all()
    assert counted["tf"].sum() == totals.sum()
    least = np.sort(totals)[-tfidf.BUCKETS_PER_TERM * 100]
    some = tfidf.corpus_term_counts(docs, tfidf.in_buckets(terms, totals >= least))
    assert some.count() < len(counted) / 10


def test_no_documents_have_no_terms(docs):
    assert tfidf.fit_terms(docs.limit(0), "tokens", TextFeatures(5)).num_rows == 0


def test_state_of_parts_equals_one_fit(spark, docs, tmp_path):
    spec = TextFeatures(300, (1, 2), 2, 0.9)
    first, second, third = (docs.where(F.col("doc_id") % 3 == i) for i in range(3))
    state = TermState.create(first, "tokens", spec, str(tmp_path / "v1"), 8)
    state = state.add(second, "tokens", str(tmp_path / "v2"))
    # Reopened, as another session would.
    state.drop()
    state = TermState.open(spark, str(tmp_path / "v2"), spec).add(third, "tokens", str(tmp_path / "it's v3"))
    assert state.n_docs == docs.count()
    assert rows(state.counts()) == rows(tfidf.corpus_term_counts(docs, spec.terms("tokens")))
    assert state.vocabulary().to_pydict() == full(docs, spec).to_pydict()
    other = TextFeatures(20, (1, 2))
    assert state.vocabulary(other).to_pydict() == full(docs, other).to_pydict()
    with pytest.raises(ValueError):
        state.vocabulary(TextFeatures(20))
    state.drop()


def test_only_new_counts_are_shuffled(spark, docs, tmp_path):
    state = TermState.create(docs, "tokens", TextFeatures(100), str(tmp_path / "v1"), 8)
    plan = state.merged(docs, "tokens")._jdf.queryExecution().executedPlan().toString()
    old = plan[plan.index("SortMergeJoin"):]
    # The side of the table comes first; it has neither an exchange nor a sort over one.
    table_side = old[: old.index("HashAggregate")] if "HashAggregate" in old else old
    assert "Bucketed: true" in plan and "Exchange" not in table_side.split("FileScan")[0]
    state.drop()


def test_a_state_without_documents(spark, docs, tmp_path):
    spec = TextFeatures(50)
    state = TermState.create(docs.limit(0), "tokens", spec, str(tmp_path / "v1"), 4)
    assert state.vocabulary().num_rows == 0
    grown = state.add(docs, "tokens", str(tmp_path / "v2"))
    assert grown.vocabulary().to_pydict() == full(docs, spec).to_pydict()
    for one in (state, grown):
        one.drop()

def test_buckets_grow_with_their_terms(spark, docs, tmp_path, monkeypatch):
    """A task sorts one bucket, whose size must not grow with the table."""
    from candor.operators import term_state

    monkeypatch.setattr(term_state, "TERMS_PER_BUCKET", 500)
    spec = TextFeatures(300)
    few, rest = docs.where("doc_id < 20"), docs.where("doc_id >= 20")
    first = TermState.create(few, "tokens", spec, str(tmp_path / "v1"), 2)
    state = first.add(rest, "tokens", str(tmp_path / "v2"))
    assert state.buckets > first.buckets >= 2
    assert state.counts().count() <= 500 * state.buckets
    assert rows(state.counts()) == rows(tfidf.corpus_term_counts(docs, spec.terms("tokens")))
    again = TermState.open(spark, str(tmp_path / "v2"), spec)
    assert again.buckets == state.buckets and again.vocabulary().equals(state.vocabulary())
    for one in (first, state, again):
        one.drop()
