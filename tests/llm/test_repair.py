import hashlib
import random
import re
import zlib
from itertools import product as words_of

import pytest

from colloquy.llm import repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
FINE = re.compile(r"(s?(ua)+)?")
ROLE = {"u": "user", "a": "assistant"}


def cheapest(kinds, faults):
    """(cost, audit, lines): a plain walk over rows and states, keeping whole audits. Lines are (row or None, role)."""
    after = {"s": {"0": "s"}, "u": {"0": "u", "s": "u", "a": "u"}, "a": {"u": "a"}}

    def relax(best):
        for _ in range(3):
            for state, (cost, audit, lines) in list(best.items()):
                for role in "ua":
                    if (then := after[role].get(state)) and (option := (cost + 3, audit + "I", (*lines, (None, ROLE[role])))) < best.get(then, (1e9,)):
                        best[then] = option
        return best

    def sortable(option):
        return option[:2]

    best = relax({"0": (0, "", ())})
    for row, (kind, fault) in enumerate(zip(kinds, faults, strict=True)):
        new = {}
        for state, (cost, audit, lines) in best.items():
            options = [(state, cost + 4, "D", lines)]
            if fault not in "bd":
                extra = 3 if fault == "t" else 0
                if state in after.get(kind, {}):
                    options.append((after[kind][state], cost + extra, "K", (*lines, (row, None))))
                options += [(after[r][state], cost + 3 + extra, "R", (*lines, (row, ROLE[r]))) for r in "ua" if state in after[r]]
            for end, paid, letter, written in options:
                option = paid, audit + letter, written
                if end not in new or sortable(option) < sortable(new[end]):
                    new[end] = option
        best = relax(new)
    return min((best[s] for s in "0a" if s in best), key=sortable)


def damaged(rows):
    """The contract's damage, row by row."""
    out = []
    for conv, turn, role, text in rows:
        spaced = [" " if v is None else v for v in (conv, turn, role, text)]
        role, text = spaced[2:]
        v = zlib.crc32(f"{spaced[0]}:{spaced[1]}".encode()) % 20
        if v == 0:
            continue
        text = "" if v == 1 else re.sub("[.!?]", "", text) if v == 2 else text
        out += [(conv, turn, "user" if v == 4 else role, text)] * (2 if v == 3 else 1)
    return out


def by_hand(conv, rows):
    def digest(role, text):
        return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()

    rows = [(r[1], " " if r[2] is None else r[2], " " if r[3] is None else r[3]) for r in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], digest(*r[1:])))
    seen, faults = set(), ""
    for _, role, text in rows:
        ended = text.strip(" \t\n\x0b\f\r")
        faults += "b" if not ended else "d" if (role, text) in seen else "t" if ended[-1] not in ".!?" else "n"
        seen.add((role, text))
    kinds = [r[1][:1] for r in rows]
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(kinds, kinds[1:], strict=False))
    cost, audit, lines = cheapest(kinds, faults)
    written = [f"{role or rows[k][1]}:{rows[k][2]}" if k is not None else f"{role}:" for k, role in lines]
    initials = "".join(w[0] for w in written)
    assert FINE.fullmatch(initials)
    return (conv, gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit,
            hashlib.sha256("\n".join(written).encode()).hexdigest())


def agree(spark, rows, damage=True):
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    left = damaged(rows) if damage else rows
    got = repair.report(repair.damaged(table) if damage else table, table).collect()
    want = [by_hand(conv, [r for r in left if r[0] == conv]) for conv in {r[0] for r in rows}]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def odd_conversation(rng, conv, n):
    texts = ["Yes.", "No!", "why?", "cut off", " ", "", "A. \n", None, "é", "same here."]
    return [(conv, rng.choice([None, k, k, k + 1, 2 * k]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]),
             rng.choice(texts) if rng.random() < 0.4 else f"Row {k}{rng.choice('.!?x')}") for k in range(n)]


def test_every_short_sequence():
    """All sequences of up to three symbols, and longer random ones, with and without rules."""
    rng = random.Random(2)
    sequences = ["".join(s) for n in range(1, 4) for s in words_of(repair.SYMBOLS, repeat=n)]
    sequences += ["".join(rng.choice(repair.SYMBOLS) for _ in range(rng.randrange(4, 40))) for _ in range(300)]
    sequences += ["ua" * 30] * 200
    plain, ruled = repair.Grammar(), repair.Grammar()
    for _ in range(6):
        counts = sum((repair.count_pairs(ruled.compress(s)) for s in sequences), repair.Counter())
        ruled.add_round([pair for pair, _ in counts.most_common(25)])
    assert len(ruled.compress("ua" * 30)) <= 8
    for s in sequences:
        kinds, faults = s.lower().replace("x", "u"), "".join("b" if c == "x" else "t" if c.isupper() else "n" for c in s)
        want = cheapest(kinds, faults)[:2]
        for grammar in (plain, ruled):
            matrix = grammar.matrix(s)
            end = repair.best_end(*repair.follow([repair.flat(matrix)], 0)[:2])
            cost, rope = matrix[0][end]
            closes = repair.closing(end)
            assert (cost + 3 * closes, "".join(repair.letters(rope)) + "I" * closes) == want, s


def test_conversations(spark):
    rng = random.Random(3)
    rows = [r for conv in range(150) for r in odd_conversation(rng, conv, rng.randrange(1, 12))]
    rows += [(None, k, "user" if k % 2 else "assistant", f"No id {k}.") for k in range(5)]
    rows += rows[:40]  # repeated rows
    agree(spark, rows)
    agree(spark, rows, damage=False)


@pytest.mark.parametrize("bits", [1, 2])
def test_blocks_and_levels(spark, monkeypatch, bits):
    """Blocks of two or four rows, combined over several levels, change nothing."""
    monkeypatch.setattr(repair, "BITS", bits)
    rng = random.Random(4)
    agree(spark, [r for conv in range(12) for r in odd_conversation(rng, conv, rng.randrange(1, 60))], damage=False)


def test_a_third_of_all_rows(spark):
    """One conversation with very many rows, and one whose rows are all alike."""
    rng = random.Random(5)
    rows = odd_conversation(rng, 1, 3000) + [(2, 1, "user", "Same.")] * 1500 + odd_conversation(rng, None, 50)
    agree(spark, rows + [r for conv in range(3, 300) for r in odd_conversation(rng, conv, 5)])


def test_documents(spark, sf_dir):
    agree(spark, [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()])


def test_empty_and_all_dropped(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repair.report(repair.damaged(empty), empty).count() == 0
    one = spark.createDataFrame([(1, 2, "user", "x")], SCHEMA)
    row = repair.report(one.limit(0), one).first()
    assert tuple(row) == (1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_repaired_rows(spark):
    rows = [(1, 0, "system", "Be brief."), (1, 1, "assistant", "Hello."), (1, 2, "user", "Hi!"), (1, 2, "user", "Hi!"),
            (1, 3, "assistant", " "), (1, 4, "user", "Well?")]
    table = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "7 AS at", "'x' AS block", "1.5 AS cost")
    fixed = [tuple(r)[3:] for r in sorted(repair.repaired_rows(table).collect(), key=lambda r: (r.at, r.part))]
    assert [r[1][0] for r in fixed] in (list("suaua"), list("sua"), list("suauaua")[:5])
    report = repair.report(table, table).first()
    assert FINE.fullmatch("".join(r[1][0] for r in fixed))
    assert hashlib.sha256("\n".join(f"{r[1]}:{r[2]}" for r in fixed).encode()).hexdigest() == report.repaired_sha256
