import random

import pytest

from factloom.operators.expansion import Limits, events, expanded, replay_ids

pytestmark = pytest.mark.usefixtures("small_plans")

KIND = "path string, n_bytes long, problem string, tokens array<string>"


def plain(directory, args, files, limits):
    """One command, depth first: the first error and its token, or the tokens with the file each is from."""
    out, state, seen = [], {"work": 0, "bytes": 0}, set()

    class Refused(Exception):
        pass

    def spend(token):
        if state["work"] >= limits.work:
            raise Refused("too_much_work", token)
        state["work"] += 1

    def put(token, path):
        if len(out) >= limits.tokens:
            raise Refused("too_many_tokens", token)
        out.append((token, path))

    def follow(token, depth, active):
        if depth > limits.depth:
            raise Refused("too_deep", token)
        spend(token)
        name = token[1:]
        path = name if name.startswith("/") else f"{directory}/{name}"
        if path in active:
            raise Refused("cycle", token)
        if path not in files:
            raise Refused("missing", token)
        size, problem, tokens = files[path]
        if path not in seen:
            if size > limits.file_bytes:
                raise Refused("file_too_large", token)
            if state["bytes"] + size > limits.total_bytes:
                raise Refused("total_too_large", token)
            if problem:
                raise Refused(problem, token)
            seen.add(path)
            state["bytes"] += size
        for t in tokens:
            spend(t)
            if t.startswith("@"):
                follow(t, depth + 1, [*active, path])
            else:
                put(t, path)

    try:
        for i, t in enumerate(args):
            if i and t.startswith("@"):
                follow(t, 1, [])
            else:
                put(t, None)
    except Refused as e:
        return e.args
    return out, len(seen), state["bytes"]


@pytest.mark.parametrize("seed,limits", [(1, Limits()), (2, Limits(depth=2)), (3, Limits(work=25)), (4, Limits(tokens=12)), (5, Limits(total_bytes=90, file_bytes=60)), (6, Limits(3, 70, 150, 20, 40))])
def test_nests_against_a_plain_walk(spark, seed, limits):
    """Repeats, diamonds, cycles, missing and unreadable files, every budget."""
    rng = random.Random(seed)
    names = [f"f{k}" for k in range(14)]
    files = {}
    for k, n in enumerate(names):
        refs = [f"@{rng.choice(names[k:] + ['gone'] if rng.random() < 0.9 else names)}" for _ in range(rng.choice([0, 0, 1, 2]))]
        tokens = [f"t{rng.randint(0, 9)}" for _ in range(rng.randint(0, 4))] + refs
        rng.shuffle(tokens)
        files[f"/d/{n}"] = (rng.randint(1, 80), rng.choice([None] * 12 + ["bad_encoding"]), tokens)
    commands = [(i, "/d", ["cl", *(rng.choice(["a", "b", "@f0", f"@{rng.choice(names)}", f"@/d/{rng.choice(names)}"]) for _ in range(rng.randint(0, 4)))]) for i in range(60)]
    df = spark.createDataFrame(commands, "id long, directory string, args array<string>")
    results, tokens = expanded(events(df, spark.createDataFrame([(p, *f) for p, f in files.items()], KIND), limits), limits)
    got = {r.id: r for r in results.collect()}
    said = {}
    for t in sorted(tokens.collect(), key=lambda t: (t.id, t.n)):
        said.setdefault(t.id, []).append((t.token, t.path))
    errors = set()
    for i, directory, args in commands:
        want = plain(directory, args, files, limits)
        if isinstance(want[0], str):
            assert (got[i].error, got[i].at) == want and i not in said
            errors.add(want[0])
        else:
            assert got[i].error is None and (said[i], got[i].n_files, got[i].n_bytes) == want and got[i].n_tokens == len(want[0])
    assert errors
    assert replay_ids(tokens).count() == len(said)


def test_work_stays_within_its_budget(spark):
    """Files that double at each level: 2 to the 30th tokens if they were all followed."""
    files = [(f"/d/f{k}", 1, None, [f"@f{k + 1}", f"@f{k + 1}"]) for k in range(30)] + [("/d/f30", 1, None, ["x"])]
    limits = Limits(depth=40, work=500)
    rows = events(spark.createDataFrame([(1, "/d", ["cl", "@f0"])], "id long, directory string, args array<string>"), spark.createDataFrame(files, KIND), limits)
    assert rows.count() < 5 * limits.work
    assert expanded(rows, limits)[0].first().error == "too_much_work"
