import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from cohortlens.llm import conversations as C
from cohortlens.llm.queries import op13_conversations

LEGAL = re.compile("(s?(ua)+)?")
SCHEMA = "conv_id long, turn long, role string, text string"
# States of the legal sequences: nothing yet, after s, after u, after a.
MOVES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
OPEN = {"u": "user", "a": "assistant"}


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        by = zlib.crc32(key.encode()) % 20
        if by == 0:
            continue
        text = "" if by == 1 else re.sub("[.!?]", "", text) if by == 2 else text
        role = "user" if by == 4 else role
        out += [(conv, turn, role, text)] * (2 if by == 3 else 1)
    return out


def faults(rows):
    seen, found = set(), []
    for _, _, role, text in rows:
        bare = text.strip(" \t\n\v\f\r")
        if not bare:
            found.append("blank")
        elif (role, text) in seen:
            found.append("duplicate")
        else:
            found.append("truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return found


def cheapest(rows, found):
    """(cost, audit, repaired turns), row by row over the states; two insertions in a row reach every state."""

    def add(best, state, cost, audit, turns):
        if state not in best or (cost, audit) < best[state][:2]:
            best[state] = cost, audit, turns

    def inserted(best):
        for _ in range(3):
            for state, (cost, audit, turns) in list(best.items()):
                for x, role in OPEN.items():
                    if (state, x) in MOVES:
                        add(best, MOVES[state, x], cost + 5, audit + "I", (turns, (role, "")))
        return best

    best = {0: (0, "", None)}
    for (_, _, role, text), fault in zip(rows, found, strict=True):
        then = {}
        for state, (cost, audit, turns) in inserted(best).items():
            add(then, state, cost + 2, audit + "D", turns)
            if fault not in ("blank", "duplicate"):
                extra = 5 if fault else 0
                if (state, role[:1]) in MOVES:
                    add(then, MOVES[state, role[:1]], cost + extra, audit + "K", (turns, (role, text)))
                for x, given in OPEN.items():
                    if (state, x) in MOVES:
                        add(then, MOVES[state, x], cost + 1 + extra, audit + "R", (turns, (given, text)))
        best = then
    best = inserted(best)
    cost, audit, chain = min((best[s] for s in (0, 3) if s in best), key=lambda b: b[:2])
    turns = []
    while chain:
        chain, turn = chain
        turns.append(turn)
    return cost, audit, turns[::-1]


def expected(rows):
    """Result per conversation of rows that are damaged already."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == conv]
        order = lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).digest())
        mine.sort(key=order)
        found = faults(mine)
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        pairs = [a[2][:1] + b[2][:1] for a, b in itertools.pairwise(mine)]
        cost, audit, repaired = cheapest(mine, found)
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
        illegal = sum(p not in ("su", "ua", "au") for p in pairs)
        out[conv] = (gaps, *(found.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha)
    return out


def outcome(spark, df, **options):
    got = C.repaired(df, **options)
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    digests = {r.conv_id: r.repaired_sha256 for r in C.digests(got.turns).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    return {r.conv_id: (*(r[n] for n in names), digests.get(r.conv_id, empty)) for r in got.report.collect()}


def drawn(n, seed, longest=9):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \t", "ok. ", "Done. x", None, "é!"]
    rows = []
    for conv in range(n):
        turn = 0
        for _ in range(rng.randrange(1, longest)):
            turn += rng.choice([0, 1, 1, 1, 1, 2])
            role = rng.choice(["user", "user", "assistant", "assistant", "system", "tool", "", None])
            rows.append((conv, rng.choice([turn] * 9 + [None]), role, rng.choice(texts)))
    return rows


def test_the_grammar_is_the_pattern():
    parser = C.parser()
    for n in range(7):
        for word in itertools.product("usax", repeat=n):
            stacks = [parser.bottom]
            for x in word:
                stacks = [new for s in stacks for new in parser.after(s, x)]
            assert any(map(parser.accepts, stacks)) == bool(LEGAL.fullmatch("".join(word)))


def test_an_ambiguous_grammar_keeps_one_stack_per_top():
    grammar = C.Grammar((("S", ("S", "S")), ("S", ("u",)), ("S", ("a",))))
    parser = C.parser(grammar)
    stacks = [parser.bottom]
    for x in "uaua":
        stacks = [new for s in stacks for new in parser.after(s, x)]
        assert stacks
    assert any(map(parser.accepts, stacks))


@pytest.mark.parametrize("segment", [1, 2, 5, 4096])
def test_segments_of_any_length_equal_brute_force(spark, segment):
    rows = damaged(drawn(250, 4)) + damaged([(None, 1, "user", "a."), (None, 2, None, "b"), (None, None, "assistant", "c.")])
    got = outcome(spark, spark.createDataFrame(rows, SCHEMA), segment=segment)
    assert got == expected(rows)


def test_one_long_conversation_is_dealt_over_tasks(spark):
    rng = random.Random(9)
    rows = [(7, k, rng.choice(["user", "assistant", "user", "system"]), rng.choice(["Yes.", f"No {k}!", "cut", f"{k}."]))
            for k in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = outcome(spark, df, segment=100)
    assert got == expected(rows)
    segments = C._segments(C._marked(df), C.Repairer(), 100)
    assert segments.count() >= 30


def test_copies_of_a_turn_are_counted(spark):
    rows = [(1, 1, "user", "Hi.")] * 5 + [(1, 2, "assistant", "Yo.")] + [(1, 2, "assistant", " ")] * 3
    assert outcome(spark, spark.createDataFrame(rows, SCHEMA)) == expected(rows)


def test_very_long_texts_extra_columns_and_an_empty_table(spark):
    rows = [(1, 1, "user", "x" * 3_000_000 + "."), (1, 2, "assistant", "\n" * 1_000_000 + "y")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"segment": F.lit(1), "digest": F.lit("d"), "c": F.lit(0)})
    assert outcome(spark, df) == expected(rows)
    assert outcome(spark, spark.createDataFrame([], SCHEMA)) == {}


def test_weights_decide(spark):
    rows = [(1, 1, "user", "a."), (1, 2, "user", "b.")]
    df = spark.createDataFrame(rows, SCHEMA)
    audits = {}
    for weights in (C.Weights(), C.Weights(rerole=9, delete=9, insert=1)):
        audits[weights.insert] = C.repaired(df, weights).report.first().audit
    assert audits == {5: "KR", 1: "KIKI"}


def test_damage_equals_its_rules(spark):
    rows = drawn(60, 2)
    got = C.damaged(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(damaged(rows), key=repr)


def compared(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").collect()]
    want = expected(damaged(rows))
    none = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    want = {r[0]: want.get(r[0], none) for r in rows}
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = op13_conversations(spark, str(folder)).collect()
    assert len(got) == len(want)
    assert {r.conv_id: tuple(r[n] for n in names) for r in got} == want
    return got


def test_query_on_every_conversation(spark):
    assert len(compared(spark, "/root/testdata/sf0.1")) > 900


def test_query_with_nulls_and_lost_conversations(spark, tmp_path):
    rows = [(None, None, None, None), (None, 3, "user", "x."), *drawn(80, 5, longest=3)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    got = compared(spark, tmp_path)
    assert any(r.audit == "" for r in got)
