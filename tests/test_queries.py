"""Every query with SQL against DuckDB, and the registry's shape."""

import os

import duckdb
import pandas as pd
import pytest

from tapeline.plans import queries as plans

SF = "/root/testdata/sf0.01"
QUERIES, ORACLE = plans.queries(), plans.oracle_sql()


@pytest.fixture
def duck():
    """A connection of its own for each test: an error in one leaves the others alone."""
    c = duckdb.connect()
    for f in os.listdir(SF):
        p = f"{SF}/{f}"
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    yield c
    c.close()


def rows(df):
    df = df[sorted(df.columns)]
    clean = lambda v: None if v is None or v != v else float(v) if hasattr(v, "as_tuple") or isinstance(v, float) else int(v) if isinstance(v, int) and not isinstance(v, bool) else v
    return sorted((tuple(clean(v) for v in r) for r in df.astype(object).where(df.notna(), None).itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) > 0 and rows(got) == rows(want)


def test_entry_imports_without_the_corpus_part():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_halo_chunks_give_the_same_as_whole_symbols(spark, monkeypatch):
    from tapeline.operators import features
    from tapeline.plans import tapes

    b = tapes.event_bars(spark, SF).cache()
    whole = {(r.symbol, r.seq): r.sadf for r in features.sadf(b).collect()}
    monkeypatch.setattr(features, "CHUNK", 130)
    parts = features.sadf(b).collect()
    assert len(parts) == len(whole) and all(abs((r.sadf or 0) - (whole[r.symbol, r.seq] or 0)) < 1e-9 for r in parts)
    b.unpersist()


def test_rolling_barriers_follow_the_seed(spark):
    from tapeline.operators import barriers
    from tapeline.plans import tapes

    b = tapes.event_bars(spark, SF).filter("symbol = 'view' and seq <= 200")
    one = barriers.rolling_barriers(b, n_paths=200, digits=1).orderBy("seq").collect()
    two = barriers.rolling_barriers(b.repartition(7), n_paths=200, digits=1).orderBy("seq").collect()
    assert one == two and all(r.optimal_pt == 2.0 for r in one[:60])


def test_rolling_barriers_query_simulates_every_phi_on_all_paths(spark, monkeypatch):
    import __spark_entry__
    from tapeline.operators import barriers
    from tapeline.plans import tapes

    seen = []

    def simulate(phis, n_paths=10_000, **rest):
        seen.append((n_paths, {r.phi for r in phis.select("phi").collect()}))
        return found(phis, n_paths=n_paths, **rest)

    found = barriers.best_for_phi
    monkeypatch.setattr(barriers, "best_for_phi", simulate)
    got = __spark_entry__.queries()["rolling_barriers"](spark, "/root/testdata/sf0.001")
    fit = barriers.ou_fit(barriers.rolling_slices(tapes.event_bars(spark, "/root/testdata/sf0.001")))
    assert seen == [(10_000, {r.phi for r in fit.filter("sigma > 0").collect()})] and seen[0][1]
    assert got.count() == tapes.event_bars(spark, "/root/testdata/sf0.001").count()


def test_pca_scores_are_uncorrelated_on_train(spark):
    p = QUERIES["pca_scores"](spark, SF).toPandas()
    t = p[(p.split == "train") & (p.symbol == "view")][["pca_1", "pca_2", "pca_3"]]
    c = t.corr().to_numpy()
    assert abs(c[0, 1]) < 1e-3 and abs(c[0, 2]) < 1e-3


def test_models_report(spark):
    r = {x.name: x for x in QUERIES["model_report"](spark, SF).collect()}
    assert set(r) == {"0", "1", "2", "macro", "weighted", "accuracy"} and 0 <= r["accuracy"].f1 <= 1
    s = QUERIES["latest_signals"](spark, SF).toPandas()
    assert len(s) == 5 and s.conviction.between(0, 1).all()
    assert isinstance(s, pd.DataFrame)
