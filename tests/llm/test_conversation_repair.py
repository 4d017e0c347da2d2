from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest

from coldledger.llm import conversation_repair as repair
from coldledger.llm import queries

SHAPE = re.compile("(s?(ua)+)?")
EMPTY = hashlib.sha256(b"").hexdigest()
SCHEMA = "conv_id long, turn long, role string, text string"


def slow_edits(messages, extra=2):
    """Least (cost, audit) by trying all edits with up to ``extra`` insertions at each place."""
    best = None
    gaps = [["I" * k for k in range(extra + 1)]]
    options = [p for m in messages for p in (gaps[0], ["D"] if m[1] else ["D", "K", "R"])] + gaps
    for parts in itertools.product(*options):
        audit = "".join(parts)
        for roles in itertools.product("ua", repeat=sum(c in "IR" for c in audit)):
            free, i, cost, shape = iter(roles), 0, 0, ""
            for c in audit:
                if c == "I":
                    shape, cost = shape + next(free), cost + 2
                    continue
                if c == "D":
                    cost += 3
                else:
                    shape += messages[i][0] if c == "K" else next(free)
                    cost += 2 * (c == "R") + messages[i][2]
                i += 1
            if SHAPE.fullmatch(shape) and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


def forward(messages):
    """The same for any length: all states, message by message, with their least (cost, audit)."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    other = {"": "u", "s": "u", "u": "a", "a": "u"}

    def inserted(ways):
        for _ in range(2):
            for q, (cost, audit) in list(ways.items()):
                ways[other[q]] = min(ways.get(other[q], (1e9, "")), (cost + 2, audit + "I"))
        return ways

    ways = {"": (0, "")}
    for initial, must_go, cut in messages:
        new = {}
        for q, (cost, audit) in inserted(ways).items():
            found = [(q, 3, "D")]
            if not must_go:
                found += [(step[q, initial], cut, "K")] if (q, initial) in step else []
                found.append((other[q], 2 + cut, "R"))
            for after, c, letter in found:
                new[after] = min(new.get(after, (1e9, "")), (cost + c, audit + letter))
        ways = new
    return min(inserted(ways)[q] for q in ("", "a") if q in ways)


def some_messages(rng, n):
    return [(rng.choice("ssuuuaaax "), rng.random() < 0.2, rng.random() < 0.3) for _ in range(n)]


def test_search_against_all_edits():
    rng = random.Random(1)
    for n in [0, 1, 1, 1, 2, 2, 2, 2, 3, 3, 3]:
        messages = some_messages(rng, n)
        assert repair.search(messages, repair.START) == slow_edits(messages) == forward(messages), messages


@pytest.mark.parametrize("seed", range(40))
def test_search_against_the_forward_pass(seed):
    rng = random.Random(seed)
    messages = some_messages(rng, rng.choice([4, 8, 30, 300]))
    assert repair.search(messages, repair.START) == forward(messages)


def test_long_search():
    messages = some_messages(random.Random(2), repair.BLOCK)
    assert repair.search(messages, repair.START) == forward(messages)


@pytest.mark.parametrize("seed", range(30))
def test_segments_chained(seed):
    rng = random.Random(seed)
    messages = some_messages(rng, 40)
    cuts = sorted(rng.sample(range(1, 40), rng.randrange(0, 12)))
    chain = repair._Chain("c")
    parts = [messages[a:b] for a, b in zip([0, *cuts], [*cuts, 40], strict=True)]
    ways = [[repair.search(p, a, b) for a in repair.STATES for b in repair.STATES] for p in parts]
    for n, (part, way) in enumerate(zip(parts, ways, strict=True)):
        chain.add(n, part[0][0], part[-1][0], [w and w[0] for w in way], [w and w[1] for w in way])
    found = [(ways[n][4 * a + b], tail) for _, n, a, b, tail, _ in reversed(list(chain.choices()))]
    got = (sum(w[0] + 2 * tail for w, tail in found), "".join(w[1] + "I" * tail for w, tail in found))
    assert got == forward(messages)


def damage(rows):
    for conv, turn, role, text in rows:
        conv_, turn_, role, text = (" " if v is None else v for v in (conv, turn, role, text))
        kind = zlib.crc32(f"{conv_}:{turn_}".encode()) % 20
        row = (conv, turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
        yield from [row] * {0: 0, 3: 2}.get(kind, 1)


def slow(before, after):
    """Result rows of conversations, given all rows before and after damage."""
    out = set()
    for conv in {r[0] for r in before}:
        mine = [(t, " " if r is None else r, " " if x is None else x) for c, t, r, x in after if c == conv]
        mine.sort(key=lambda m: (m[0] is not None, m[0] or 0, m[1].encode(), m[2].encode()))
        seen, counts, messages = set(), dict.fromkeys(("blank", "duplicate", "truncated"), 0), []
        for _, role, text in mine:
            bare = re.sub("[\x20\x09-\x0D]", "", text)
            fault = ("blank" if not bare else "duplicate" if (role, text) in seen
                     else "truncated" if bare[-1] not in ".!?" else None)
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            messages.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        turns = [t for t, _, _ in mine if t is not None]
        cost, audit = forward(messages)
        lines, i, last = [], 0, None
        for c in audit:
            if c in "IR":
                last = "assistant" if last == "u" else "user"
                lines.append(f"{last}:{mine[i][2] if c == 'R' else ''}")
            elif c == "K":
                last = mine[i][1]
                lines.append(f"{last}:{mine[i][2]}")
            last = last and last[0]
            i += c != "I"
        out.add((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *counts.values(),
                 sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(messages)), cost, audit,
                 hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


def run(spark, rows, **options):
    done = repair.Repair(spark.createDataFrame(rows, SCHEMA).repartition(5), **options)
    digest = {r["conv_id"]: r["sha256"] for r in done.digests().collect()}
    return {(*r, digest.get(r["conv_id"], EMPTY)) for r in done.audits().collect()}, done


def some_rows(rng, convs, most):
    texts = ["", " \n", "Yes.", "No", "Why? ", "so...\t", "ünï!", "a b c"] + [f"text {k}." for k in range(30)]
    rows = []
    for conv in range(convs):
        for turn in range(rng.randrange(1, most)):
            rows += [(conv, turn if rng.random() > 0.05 else None, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", ""]),
                      rng.choice(texts))] * rng.choice([0, 1, 1, 1, 1, 3])
    return rows


@pytest.mark.parametrize("bits, partitions", [(11, None), (2, 13)])
def test_random_conversations(spark, monkeypatch, bits, partitions):
    monkeypatch.setattr(repair, "BLOCK_BITS", bits)
    rows = some_rows(random.Random(5), 60, 30)
    assert run(spark, rows, partitions=partitions)[0] == slow(rows, rows)


def test_one_conversation_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(repair, "BLOCK_BITS", 6)
    rng = random.Random(6)
    rows = [(9, t, rng.choice(["user", "assistant", "system"]), f"{t}." if rng.random() < 0.8 else "same") for t in range(4000)]
    rows += [(9, 5000, "user", "again.")] * 1000
    got, done = run(spark, rows, partitions=7)
    assert got == slow(rows, rows)
    assert done.pieces.count() > 60
    assert done.rows.groupBy(repair.F.spark_partition_id()).count().count() > 1


def test_odd_rows(spark):
    rows = [(None, None, None, None), (None, 1, "user", "a."), (1, None, "user", None), (1, None, "user", None), (2, 3, None, "x."),
            (3, 1, "user", "long " * 200_000 + "."), (3, 7, "assistant", "ok."), (3, 7, "assistant", "ok."), (4, 0, "sys", "s."),
            (4, -5, "assistant", "漢。"), (5, 2**40, "user", "."), (5, 0, "assistant", "!")]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'c' AS id", "'c' AS conv", "'c' AS hash", "'c' AS block", "'c' AS copies")
    done = repair.Repair(docs)
    digest = {r["conv_id"]: r["sha256"] for r in done.digests().collect()}
    assert {(*r, digest.get(r["conv_id"], EMPTY)) for r in done.audits().collect()} == slow(rows, rows)
    nothing = repair.Repair(docs.limit(0))
    assert nothing.audits().count() == nothing.repaired().count() == nothing.digests().count() == 0


def test_repaired_conversations_have_the_shape(spark):
    rows = some_rows(random.Random(8), 30, 12)
    _, done = run(spark, rows)
    shapes = {}
    for r in sorted(done.repaired().collect(), key=lambda r: (r["conv_id"], r["place"])):
        shapes[r["conv_id"]] = shapes.get(r["conv_id"], "") + r["role"][:1]
    assert shapes and all(SHAPE.fullmatch(s) for s in shapes.values())


@pytest.mark.parametrize("nulls", [False, True])
def test_query(spark, tmp_path, nulls):
    sf = "/root/testdata/sf0.001"
    if nulls:
        sf = str(tmp_path)
        rows = [(None, None, None, None), (None, 2, "user", "."), *[(k, None if k % 3 else k, "user", "x.") for k in range(50)]]
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{sf}/conversations.parquet")
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {tuple(r) for r in queries.op11_conversation_repair(spark, sf).collect()}
    assert got == slow(rows, list(damage(rows)))
