import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuspack.operators import chunks
from corpuspack.operators.chunks import CHUNK_OVERHEAD, assign_chunks


def fold(costs, budget):
    """One repository, file by file."""
    numbers, current, running, open_chunk = [], 0, CHUNK_OVERHEAD, False
    for cost in costs:
        if cost > budget:
            current, running, open_chunk = current + 1, CHUNK_OVERHEAD, False
            numbers.append(current)
            continue
        if not open_chunk or running + cost > budget:
            current, running, open_chunk = current + 1, CHUNK_OVERHEAD, True
        running += cost
        numbers.append(current)
    return numbers


def random_costs(rng, n, budget):
    kinds = [
        lambda: rng.randint(18, 60),
        lambda: rng.randint(18, max(19, budget // 3)),
        lambda: rng.randint(max(18, budget - 1100), budget + 1100),
        lambda: budget,
        lambda: budget + 1,
        lambda: max(18, budget - CHUNK_OVERHEAD),
    ]
    weights = [rng.random() for _ in kinds]
    return [rng.choices(kinds, weights)[0]() for _ in range(n)]


BUDGETS = [600, 1000, 1018, 1200, 3000, 150_000]


def random_blocks(rng, budget, longest=12):
    """Files of several repositories, cut into blocks anywhere; and the state of the fold after each."""
    repos = sorted(f"r{k}" for k in range(rng.choice([1, 1, 2, 5])))
    files = [(r, c) for r in repos for c in random_costs(rng, rng.randint(1, 60 // len(repos)), budget)]
    expected = [n for r in repos for n in fold([c for q, c in files if q == r], budget)]
    blocks, at = [], 0
    while at < len(files):
        part = files[at : at + rng.randint(1, longest)]
        first, last = part[0][0], part[-1][0]
        steps = chunks.steps_of(last, np.array([c for r, c in part if r == last]), budget)
        if first != last:
            none = np.empty(0, np.int64)
            steps = chunks.Steps(first, last, True, steps.begun, steps.running, upto=none, counts=none, exits=none)
        at += len(part)
        blocks.append((steps, (last, expected[at - 1])))
    return blocks


@pytest.mark.parametrize("budget", BUDGETS)
def test_step_functions_compose_to_the_fold(budget):
    """Blocks cut anywhere give the same state as one pass, whatever came before, in whatever order they are composed."""
    rng = random.Random(budget)
    for _ in range(150):
        blocks = random_blocks(rng, budget)
        state = (None, 0, CHUNK_OVERHEAD)
        for steps, (repo, begun) in blocks:
            state = steps.leave(*state)
            assert state[:2] == (repo, begun)
        whole = [steps for steps, _ in blocks]
        while len(whole) > 1:
            k = rng.randrange(len(whole) - 1)
            whole[k : k + 2] = [chunks.composed(whole[k], whole[k + 1])]
        assert whole[0].leave(None, 0, CHUNK_OVERHEAD) == state


@pytest.mark.parametrize("budget", BUDGETS)
def test_compositions_equal_their_parts_in_every_state(budget):
    rng = random.Random(budget + 1)
    for _ in range(100):
        one, other = (chunks.steps_of("r", np.array(random_costs(rng, rng.randint(1, 9), budget)), budget) for _ in range(2))
        both = chunks.composed(one, other)
        states = {CHUNK_OVERHEAD, budget + CHUNK_OVERHEAD, *(rng.randint(CHUNK_OVERHEAD, budget + CHUNK_OVERHEAD) for _ in range(40))}
        states |= {int(u) + d for u in [*both.upto[:-1], both.absorbs] for d in (0, 1) if u >= CHUNK_OVERHEAD}
        for running in states:
            assert both.leave("r", 3, running) == other.leave(*one.leave("r", 3, running)), (running, budget)
        assert len(both.upto) <= len(one.upto) + len(other.upto) and (np.diff(both.upto) > 0).all()


@pytest.mark.parametrize("budget", [1300, 30_000])
def test_runs_fold_alike_at_any_length(monkeypatch, budget):
    rng = random.Random(budget)
    for _ in range(60):
        costs = np.array(random_costs(rng, rng.randint(1, 120), budget))
        state = (2, rng.choice([CHUNK_OVERHEAD, CHUNK_OVERHEAD + 200, budget]))
        found = []
        for short in (0, 1000):
            monkeypatch.setattr(chunks, "SHORT_RUN", short)
            numbers, begun, running = chunks._fold(costs, *state, budget)
            found.append((numbers.tolist(), begun, running))
        assert found[0] == found[1]


def test_functions_stay_small_at_a_large_budget():
    """Sixteen blocks of 40,000 files under a budget of 20 million tokens."""
    rng, budget = np.random.default_rng(0), 20_000_000
    parts = [chunks.steps_of("r", rng.integers(50, 4000, 40_000), budget) for _ in range(16)]
    whole = parts[0]
    for part in parts[1:]:
        whole = chunks.composed(whole, part)
        assert len(whole.upto) <= 10_100  # files of a chunk, about
    assert len(whole.upto) < 2_000 and max(len(p.upto) for p in parts) <= 10_100


def assigned(spark, repos, budget):
    rows = [(repo, f"f{i:06d}", cost) for repo, costs in repos.items() for i, cost in enumerate(costs)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "repo string, path string, tokens bigint")
    result = {}
    for r in assign_chunks(df, budget).orderBy("repo", "path").collect():
        result.setdefault(r.repo, []).append(r.chunk)
    return result


@pytest.fixture
def many_blocks(spark):
    """Keep small test data in many partitions."""
    settings = {
        "spark.sql.shuffle.partitions": "13",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "7",
    }
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("budget", [1000, 1300, 4000])
def test_one_huge_repository_spans_blocks(spark, many_blocks, budget):
    rng = random.Random(budget)
    repos = {"huge": random_costs(rng, 900, budget), "a": [20], "b": [budget + 1, 20], "zz": random_costs(rng, 40, budget)}
    assert assigned(spark, repos, budget) == {r: fold(c, budget) for r, c in repos.items()}


def test_a_chunk_open_across_whole_blocks(spark, many_blocks):
    repos = {"small": [18] * 400, "tail": [18, 500_000, 18]}
    assert assigned(spark, repos, 150_000) == {"small": [1] * 400, "tail": [1, 2, 3]}


@pytest.mark.parametrize("fan", [2, 3])
def test_a_tree_of_many_levels(spark, many_blocks, monkeypatch, fan):
    monkeypatch.setattr(chunks, "FAN", fan)
    rng = random.Random(fan)
    repos = {"huge": random_costs(rng, 700, 1500), "next": random_costs(rng, 300, 1500), "z": [1501]}
    assert assigned(spark, repos, 1500) == {r: fold(c, 1500) for r, c in repos.items()}


def test_no_task_takes_all_functions(spark):
    steps = chunks.steps_of("r", np.array([20, 30]), 2000)
    rows = [row for k in range(40) for row in chunks._rows([(k, steps)])]
    plan = chunks.entry_states(spark.createDataFrame(rows, chunks._STEPS))._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Coalesce" not in plan and "Window" not in plan


def test_many_small_repositories(spark, many_blocks):
    rng = random.Random(3)
    repos = {f"r{i}": random_costs(rng, rng.randint(1, 9), 2000) for i in range(120)}
    assert assigned(spark, repos, 2000) == {r: fold(c, 2000) for r, c in repos.items()}


def test_budget_within_the_overhead_gives_single_files(spark):
    assert assigned(spark, {"r": [50, 60, 70]}, 1000) == {"r": [1, 2, 3]}


def test_other_columns_travel_along(spark):
    df = spark.createDataFrame([("r", "b", 20, "x"), ("r", "a", 20, None)], "repo string, path string, tokens bigint, note string")
    rows = assign_chunks(df, 5000).orderBy("path").collect()
    assert [(r.path, r.note, r.chunk) for r in rows] == [("a", None, 1), ("b", "x", 1)]


def test_empty_input(spark):
    df = spark.createDataFrame([], "repo string, path string, tokens bigint")
    assert assign_chunks(df, 5000).count() == 0


def test_no_text_and_no_window_in_the_plan(spark):
    df = spark.range(10).select(F.lit("r").alias("repo"), F.col("id").cast("string").alias("path"), F.lit(20).cast("bigint").alias("tokens"))
    plan = assign_chunks(df, 5000)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
