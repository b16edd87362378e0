"""Keyed state of the streams: what a bucket asks of the state store, over stand-ins of its handles."""
from collections import defaultdict
from unittest.mock import MagicMock

import numpy as np
import pandas as pd

from riskflow.streaming import scoring as SS


class Store:
    """A map and a value state that count their calls."""

    def __init__(self):
        self.held, self.value, self.calls, self.now = {}, None, 0, 0

    def getMapState(self, *_):
        return self

    def getValueState(self, *_):
        one = MagicMock()
        one.get = lambda: self.value
        one.update = lambda v: setattr(self, "value", v)
        return one

    def getValue(self, key):
        self.calls += 1
        return self.held.get(key)

    def updateValue(self, key, value):
        self.calls += 1
        self.held[key] = value

    def removeKey(self, key):
        self.calls += 1
        del self.held[key]

    def getCurrentProcessingTimeInMs(self):
        return self.now


def _worker(monkeypatch, make, columns):
    made = []

    def keyed(stream, key, order_cols, state, fold, added, ttl_ms=None, once=False):
        made.append(SS.KeyedState([*columns, "_key", "_hash", "_bucket"], order_cols, state, fold, ttl_ms, once))
        return MagicMock()
    monkeypatch.setattr(SS, "keyed", keyed)
    make()
    store = Store()
    made[0].init(store)
    return made[0], store


def _hash(key):
    return int(np.random.default_rng(0 if key is None else int(key) + 1).integers(-2**63, 2**63 - 1))


def _batch(worker, store, pdf, key):
    names = [None if k is None else str(k) for k in pdf[key]]
    full = pdf.assign(_key=pd.Series(names, dtype=object), _hash=[_hash(k) for k in names], _bucket=0)
    frames = [full.iloc[: len(full) // 2], full.iloc[len(full) // 2:]]
    return pd.concat(worker.handleInputRows((0,), iter(frames), store), ignore_index=True)


def test_a_bucket_takes_its_keys_by_leaves(monkeypatch):
    monkeypatch.setattr(SS, "LEAF_BYTES", 1 << 11)
    worker, store = _worker(monkeypatch, lambda: SS.user_state(None, "p", ("t",), history=5), ["nameOrig", "t", "p"])
    rng, past, users = np.random.default_rng(1), defaultdict(list), 3000
    for b in range(3):
        who = rng.integers(0, users, 4 * users)
        who[:40] = 7
        pdf = pd.DataFrame({"nameOrig": [None if w == 5 else str(w) for w in who], "t": rng.permutation(len(who)) + b * 10**6, "p": rng.random(len(who))})
        store.calls = 0
        got = _batch(worker, store, pdf, "nameOrig").sort_values("t")
        assert b == 0 or store.calls < users          # a call a key and more would be 2 * users and above
        assert list(got.columns) == ["nameOrig", "t", "p", "burst", "historical_risk_score"]
        want = []
        for r in pdf.sort_values("t").itertuples():
            h = past[r.nameOrig][-5:]
            want.append((len(h), sum(h) / max(len(h), 1)))
            past[r.nameOrig].append(r.p)
        assert got["burst"].tolist() == [n for n, _ in want]
        assert np.allclose(got["historical_risk_score"], [m for _, m in want], atol=1e-12)
    assert store.value[0] > 3 and max(len(v[0]) for v in store.held.values()) < 8 * SS.LEAF_BYTES
    assert all(k[0].startswith(f"{store.value[0]}/") for k in store.held)
    assert sum(len(v[0]) for v in store.held.values()) == store.value[1]


def test_first_writes_of_keys_that_share_leaves(monkeypatch):
    monkeypatch.setattr(SS, "LEAF_BYTES", 1 << 10)
    worker, store = _worker(monkeypatch, lambda: SS.first_writes(None, "id", ("t",)), ["id", "t"])
    ids = np.r_[np.arange(2000), np.arange(500)]
    seen = set()
    for b in range(3):
        pdf = pd.DataFrame({"id": [None if i % 700 == 699 else int(i) for i in ids + 900 * b], "t": np.arange(len(ids))}, dtype=object)
        got = _batch(worker, store, pdf, "id").sort_values("t")
        want = []
        for k in pdf["id"]:
            want.append(k not in seen)
            seen.add(k)
        assert got["_first"].tolist() == want
    store.calls, size = 0, len(store.held)
    assert not _batch(worker, store, pdf, "id")["_first"].any()
    assert store.calls <= size                        # delivered again: read only, nothing is written


def test_a_key_is_forgotten_by_its_own_time(monkeypatch):
    worker, store = _worker(monkeypatch, lambda: SS.first_writes(None, "id", ("t",), ttl_ms=100), ["id", "t"])
    for now, ids, want in [(0, [1, 2], [True, True]), (60, [1], [False]), (120, [1, 2], [False, True]), (219, [1, 2], [False, False]), (319, [1], [True])]:
        store.now = now                               # 1 and 2 are in one leaf, which 1 keeps alive
        got = _batch(worker, store, pd.DataFrame({"id": ids, "t": range(len(ids))}), "id").sort_values("t")
        assert got["_first"].tolist() == want, now
