"""The classifier's gradient and grades, and the packing rule, against plain forms."""

import heapq
import random

import numpy as np
import pytest

from trackweave.llm import quality_classifier as qc
from trackweave.llm.packing import balanced


def test_slopes_equal_finite_differences():
    rng = np.random.default_rng(1)
    s, y, weight, cuts = rng.normal(size=60) * 2, rng.integers(0, 3, 60), rng.uniform(0.2, 3, 60), np.array([-0.7, 0.9])
    by_score, by_cut = qc.slopes(s, y, weight, cuts)
    step = 1e-6
    assert np.allclose(by_score, (qc.losses(s + step, y, weight, cuts) - qc.losses(s - step, y, weight, cuts)) / (2 * step), atol=1e-5)
    for j in range(2):
        moved = np.eye(2)[j] * step
        assert np.allclose(by_cut[:, j], (qc.losses(s, y, weight, cuts + moved) - qc.losses(s, y, weight, cuts - moved)) / (2 * step), atol=1e-5)


def test_grades_equal_a_plain_sum(spark, awkward, awkward_docs):
    rng = np.random.default_rng(2)
    model = qc.OrdinalModel((rng.normal(size=1 << qc.BITS) * (rng.random(1 << qc.BITS) < 0.5)).astype(np.float32), np.array([-1.5, 0.5]))
    out = {r.doc_id: r for r in qc.grade(awkward_docs, model).collect()}
    for i, text, *_ in awkward:
        score = sum(float(model.weights[qc.cell(t)]) for t in sorted(qc.tokens_of(text)))
        tails = [1 / (1 + np.exp(-(score - t))) for t in model.thresholds]
        r = out[i]
        assert np.allclose([r.score, r.expected_grade, r.p_above_0, r.p_above_1], [score, sum(tails), *tails], atol=1e-9)
        assert r.kept == (r.p_above_1 >= 0.5)


def area(score, wanted):
    """Share of pairs, one wanted and one not, that the score puts in order."""
    rank = np.argsort(np.argsort(score)) + 1
    n = wanted.sum()
    return (rank[wanted].sum() - n * (n + 1) / 2) / (n * (len(wanted) - n))


def test_held_out_ratings_of_the_table_are_predicted(spark):
    """Trained without every fifth document; how well the good and the toxic ones of those are told."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = "crc32(cast(doc_id as string)) % 5 = 0"
    model = qc.learned(docs, labels.where(f"not ({held})"))
    rated = qc.ratings(labels.where(held))
    rows = qc.grade(docs.join(rated, "doc_id", "left_semi"), model).join(rated, "doc_id").collect()
    assert len(rows) > 300
    good, toxic = np.array([r.grade == 2 for r in rows]), np.array([r.grade == 0 for r in rows])
    assert np.mean((np.array([r.p_above_1 for r in rows]) >= 0.5) == good) >= 0.88  # three quarters are good
    assert area(np.array([r.p_above_1 for r in rows]), good) >= 0.94
    assert area(np.array([-r.p_above_0 for r in rows]), toxic) >= 0.9


def simulated(lengths, capacities, linear, quadratic):
    """The rule by plain loops: whole sequences first, then the longest rest to the cheapest sequence that holds it, or to the cheapest with room."""
    full = capacities[0]
    room, cost, used, out, rest, nxt = list(capacities), [0.0] * len(capacities), [0] * len(capacities), [], [], 0
    for d, n in enumerate(lengths):
        start = 0
        while n - start >= full and nxt < len(room) and capacities[nxt] == full:
            out.append((d, start, full, nxt, 0))
            room[nxt], used[nxt], start, nxt = 0, full, start + full, nxt + 1
        if start < n:
            rest.append((n - start, d, start))
    while rest:
        n, d, start = min(rest, key=lambda r: (-r[0], r[1], r[2]))
        rest.remove((n, d, start))
        able = [s for s in range(len(room)) if room[s] >= n] or [s for s in range(len(room)) if room[s]]
        s = min(able, key=lambda s: (cost[s], s))
        take = min(n, room[s])
        out.append((d, start, take, s, used[s]))
        used[s], room[s], cost[s] = used[s] + take, room[s] - take, cost[s] + linear * take + quadratic * take * take
        if take < n:
            rest.append((n - take, d, start + take))
    return out


@pytest.mark.parametrize("seed", range(8))
def test_packing_follows_the_rule(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([1, 2, 3, 5, 30, 64, 70, 200]) for _ in range(rng.randrange(1, 60))]
    total = sum(lengths)
    capacities = [64] * (total // 64) + [1 << b for b in range(5, -1, -1) if total % 64 >> b & 1]
    assert balanced(lengths, capacities, 1.0, 1 / 16) == simulated(lengths, capacities, 1.0, 1 / 16)


def test_packing_balances_cost_better_than_first_fit():
    rng = random.Random(9)
    lengths = [rng.randrange(1, 600) for _ in range(400)]
    count = sum(lengths) // 1024
    while sum(lengths) > count * 1024:
        lengths.pop()
    lengths.append(count * 1024 - sum(lengths))
    capacities = [1024] * count

    def spread(pieces):
        cost = np.zeros(count)
        for _, _, n, s, _ in pieces:
            cost[s] += n + n * n / 512
        return cost.std()

    heap, first_fit, room = [(-n, d) for d, n in enumerate(lengths)], [], list(capacities)
    heapq.heapify(heap)
    while heap:
        n, d = heapq.heappop(heap)
        s = next((s for s in range(count) if room[s] >= -n), None)
        s = next(s for s in range(count) if room[s]) if s is None else s
        take = min(-n, room[s])
        first_fit.append((d, 0, take, s, 0))
        room[s] -= take
        if take < -n:
            heapq.heappush(heap, (n + take, d))
    assert spread(balanced(lengths, capacities, 1.0, 1 / 512)) < 0.6 * spread(first_fit)
