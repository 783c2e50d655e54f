import itertools
import random
from collections import Counter

import numpy as np

from rillfold.llm import pack as pk
from rillfold.llm.tokens import encoder


def test_hilbert_is_a_walk_through_all_cells():
    bits = 3
    cells = np.array(list(itertools.product(range(1 << bits), repeat=3)))
    keys = pk.hilbert(cells, bits)
    assert sorted(keys) == list(range(8**bits))
    walk = cells[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_packer_fits_and_wastes_little():
    rng = random.Random(3)
    sizes = [rng.randint(1, 100) for _ in range(20000)]
    p = pk.Packer(100, 0)
    rows = [r for k in range(0, len(sizes), 500) for r in p.place([(s, i + k, 0, 0) for i, s in enumerate(sizes[k : k + 500])])]
    load = Counter()
    for container, _, _, _, size in rows:
        load[container] += size
    assert len(rows) == len(sizes) and max(load.values()) <= 100
    assert sum(sizes) / (100 * len(load)) > 0.98


def test_what_shares_a_container_lies_near_on_the_curve():
    """Fill, and the distance along the curve within containers against that of any two documents: packed along the curve, and all at once."""
    rng = random.Random(5)
    sizes = [min(900, int(rng.lognormvariate(4.5, 1)) + 1) for _ in range(20000)]

    def packed(span):
        p, rows, window, total = pk.Packer(1000, 0), [], [], 0
        for i, s in enumerate(sizes):
            window.append((s, i, 0, 0))
            total += s
            if total >= span * 1000:
                rows += p.place(window)
                window, total = [], 0
        rows += p.place(window)
        members = {}
        for container, i, _, _, _ in rows:
            members.setdefault(container, []).append(i)
        apart = [abs(a - b) for m in members.values() for a, b in zip(m, m[1:])]
        return sum(sizes) / (1000 * len(members)), sum(apart) / len(apart) / (len(sizes) / 3)

    fill, apart = packed(pk.SPAN)
    best, random_apart = packed(10**9)
    assert fill > 0.98 and best - fill < 0.02
    assert apart < 0.1 and random_apart > 2 * apart


def test_documents_of_one_kind_share_containers(spark):
    words = [["alpha beta gamma ", "delta "], ["übung größe straße ", "fünf "], ["文件 测试 修复 ", "代码 "]]
    texts = [(i, (words[i % 3][0] * (i % 5 + 1)) + words[i % 3][1]) for i in range(1200)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    rows = pk.pack(docs, spark.createDataFrame([(1, "byte_bpe_50k", 100)], "budget_id int, tokenizer string, capacity_tokens int")).collect()
    kinds = {}
    for r in rows:
        kinds.setdefault(r.container_id, set()).add(r.doc_id % 3)
    assert sum(len(k) == 1 for k in kinds.values()) > 0.5 * len(kinds)  # at random next to none would be


def test_rows(spark):
    texts = [None, "", "word " * 700, "a", "a", " ", "x y z " * 10, "b" * 500] + [f"commit {i} " * (i % 40 + 1) for i in range(300)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id bigint, text string, budget_id int")
    budgets = spark.createDataFrame([(1, "byte_bpe_50k", 64), (2, "byte_bpe_multi_50k", 100), (3, "byte_bpe_50k", None)], "budget_id int, tokenizer string, capacity_tokens int")
    rows = pk.pack(docs, budgets, per_partition=200).collect()
    for budget, name, capacity in ((1, "byte_bpe_50k", 64), (2, "byte_bpe_multi_50k", 100)):
        enc, mine = encoder(name), [r for r in rows if r.budget_id == budget]
        load, pieces = Counter(), {}
        for r in mine:
            load[r.container_id] += r.n_tokens
            pieces.setdefault(r.doc_id, []).append((r.first_token, r.n_tokens))
        assert set(pieces) == set(range(len(texts)))
        for i, t in enumerate(texts):
            n = len(enc.encode_ordinary(t or ""))
            at = 0
            for first, size in sorted(pieces[i]):
                assert first == at
                at += size
            assert at == n and (len(pieces[i]) == 1 if n <= capacity else len(pieces[i]) == -(-n // capacity))
        assert max(load.values()) <= capacity
        assert all(r.container_id is None for r in mine if r.n_tokens == 0)
    assert {r.budget_id for r in rows} == {1, 2}
    seen = {}
    for r in rows:
        if r.container_id is not None:
            assert seen.setdefault(r.container_id, r.budget_id) == r.budget_id
    said = {r.budget_id: tuple(r)[1:] for r in pk.fill(pk.pack(docs, budgets, per_partition=200), budgets.where("budget_id < 3")).collect()}
    assert said == {b: (len(texts) - 2, True, True, True, True) for b in (1, 2)}
    assert pk.pack(docs.limit(0), budgets).count() == 0 and pk.pack(docs, budgets.limit(0)).count() == 0
    same = spark.createDataFrame([(7, "same text")] * 50, "doc_id bigint, text string")
    assert pk.pack(same, budgets).where("budget_id = 1").count() == 50
