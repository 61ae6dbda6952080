"""Sorted lists against matrices: the same comparables' statistics, over few and many rows of a seller, equal rows, unknown and zero mileages."""

import numpy as np
import pyarrow as pa
import pytest

from advertlake.operators import cells, ladders, market
from advertlake.settings import Settings

S = Settings()


def _cell(seed, n, sellers, prices, kms, twice=0):
    r = np.random.default_rng(seed)
    maybe = lambda values, p: pa.array([None if r.random() < p else v for v in values])
    ids = [f"{i:05}" for i in range(n)]
    year, price = r.integers(2015, 2020, n), r.choice(r.uniform(500, 30_000, prices), n)
    km = maybe([int(x) for x in r.choice(np.r_[0, r.integers(1, 200_000, kms)], n)], 0.15)
    gear, engine = maybe([str(x) for x in r.choice(["a", "m"], n)], 0.3), maybe([float(x) for x in r.choice([1.0, 1.4], n)], 0.3)
    targets = pa.table({"t_id": ids, "t_year": year, "t_km": km, "t_price_gbp": price, "t_transmission": gear, "t_engine_l": engine, "t_gbp_first": year % 2 == 0})
    rows = pa.table({"id": ids, "year": year, "km": km, "price_gbp": price, "gbp": r.random(n) < 0.6, "seller": maybe([int(x) for x in r.integers(0, sellers, n)], 0.02), "is_active": r.random(n) < 0.6, "transmission": gear, "engine_l": engine})
    rows = rows.take(pa.array(np.sort(r.permutation(n)[: n // 2])))
    return cells.Cell(targets, pa.concat_tables([rows, rows.slice(0, twice)]), S)


def _numbers(step):
    return [np.nan if v is None else v for k, v in step.items() if k != "ids"]


@pytest.mark.parametrize("case", [(1, 600, 15, 600, 500), (2, 600, 300, 600, 500), (3, 600, 100_000, 6, 5), (4, 300, 90, 30, 20, 10), (5, 600, 100_000, 2, 600), (6, 900, 250, 900, 900)])
def test_lists_equal_matrices(monkeypatch, case):
    cell = _cell(*case)

    def both(of):
        out = []
        for least in (1 << 60, 0):
            monkeypatch.setattr(cells, "LADDER", least)
            out.append(of().to_pylist())
        return [sorted(x, key=lambda x: x["t_id"]) for x in out]

    plain, lists = both(lambda: market._cell_steps(cell, False))
    ids = sorted(market._cell_steps(cell, True).to_pylist(), key=lambda x: x["t_id"])
    assert len(plain) == len(lists) == len(ids) > 50
    for a, b, c in zip(plain, lists, ids, strict=True):
        assert [a["t_id"], len(a["steps"])] == [b["t_id"], len(b["steps"])] == [c["t_id"], len(c["steps"])]
        for x, y, z in zip(a["steps"], b["steps"], c["steps"], strict=True):
            assert _numbers(x) == pytest.approx(_numbers(y), rel=1e-11, abs=1e-11, nan_ok=True), (x, y)
            assert _numbers(x) == pytest.approx(_numbers(z), rel=1e-11, nan_ok=True)
    plain, lists = both(lambda: market._cell_medians(cell))
    assert len(plain) > 50 and plain == lists
    plain, lists = both(lambda: market._cell_nearest(cell, 5))
    key = lambda x: (x["t_id"], x["rank"])
    assert len(plain) > 1000 and sorted(plain, key=key) == sorted(lists, key=key)


def test_nearest_compares_few_rows(monkeypatch):
    cell, compared = _cell(8, 3000, 100_000, 3000, 3000), []
    plain = ladders._spread
    monkeypatch.setattr(ladders, "_spread", lambda low, high: compared.append(np.maximum(high - low, 0).sum()) or plain(low, high))
    monkeypatch.setattr(cells, "LADDER", 0)
    assert len(market._cell_nearest(cell, 5)) == 5 * 3000
    assert sum(compared) < 100 * 3000


def test_equal_questions_are_answered_once():
    cell = _cell(3, 600, 100_000, 6, 5)
    like = next(cell.alike())
    some, _, back = cell.asked(like, cell.candidates(like[0], 1))
    assert len(back) == len(like) > len(some)


def test_many_targets_form_no_pairs(monkeypatch):
    """Where sellers have few rows, the matrices of a whole cell hold no more than a few entries per target."""
    cell, entries = _cell(7, 3000, 100_000, 3000, 3000), []
    plain = cells.Cell.capped
    monkeypatch.setattr(cells.Cell, "capped", lambda self, own, cols: entries.append(len(own) * len(cols)) or plain(self, own, cols))
    monkeypatch.setattr(cells, "LADDER", 0)
    assert len(market._cell_medians(cell)) > 2000
    assert sum(entries) < 10 * 3000
