"""Conversation structure repair: a dynamic program over grammar-compressed sequences.

A conversation is fine if the initials of its roles read ``(s?(ua)+)?``. Each row is one symbol: the
initial of its role and its first fault (blank, a copy of an earlier row, cut off). A symbol is a min-plus matrix over
the four states of that expression (nothing yet, after s, after u, after a): the least cost from state to
state of any inserts and the row's own edit, with the letters of those edits as a rope, the least of equals by
ASCII. A concatenation multiplies matrices. No letters of a part begin others of it, so the lesser beginning decides.

Re-Pair: over the distinct symbol sequences of all conversations the most frequent neighbouring pairs become
rules, round by round. Each rule has one matrix, the product of its two sides, made once and shared by every
conversation; its ropes hold the ropes of the sides. What is left of a sequence is multiplied along.

At scale: rows are sorted by range over (conversation, turn, role, digest), so a conversation with a third of all rows lies
over many tasks, and cut into blocks of at most ``1 << BITS`` rows; only copies of one digest meet
(pre-aggregated). Blocks of a conversation are combined as small matrices (costs and the order of the
letters), up to ``1 << BITS`` at a time, level over level, and the chosen states are traced back down.
Per round of the grammar at most ``PAIRS`` pairs reach the driver; there are at most ``ROUNDS`` rounds. They
bound the table of rules and do not change results. The repaired text is written block by block; the
digest of a conversation of several blocks is streamed.

Cases: null roles and texts are one space, so such a text is blank; null turns come first and do not count for gaps; rows of equal turns
follow by role, then by the SHA-256 of role and text; repeated rows are copies, of which the first stays; roles of other
initials (empty ones too) can only be rewritten or deleted; a null conversation id is a conversation; a conversation without rows is
fine as it is; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import functools
import uuid
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.plans.runtime import has_rows, materialize

BITS = 9  # a block has up to 2 to this power rows, a level up to as many blocks
ROUNDS, PAIRS = 12, 128
REMEMBERED = 50_000  # sequences whose matrices a worker process remembers

STATES = range(4)  # nothing yet, after s, after u, after a
SYMBOLS = "suaoSUAOx"  # initials (o: any other), of rows cut off in capitals; x: blank or a copy
AFTER = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
NAMES = {2: "user", 3: "assistant"}  # what is inserted, or written over, to get into a state
INSERT, REROLE, DELETE, CUT_OFF = 3, 3, 4, 3
SPACE = " \t\n\x0b\f\r"

Rope = str | tuple
Cell = tuple[int, Rope] | None
Matrix = list[list[Cell]]


def letters(rope: Rope):
    waiting = [rope]
    while waiting:
        part = waiting.pop()
        if isinstance(part, str):
            yield from part
        else:
            waiting += reversed(part)


def comes_first(one: Rope, other: Rope) -> bool:
    return next((a < b for a, b in zip(letters(one), letters(other), strict=False) if a != b), False)


def inserted(state: int) -> int:
    """The state after an insert: a user's row, or an assistant's after a user's."""
    return 3 if state == 2 else 2


def inserts(state: int) -> list[tuple[int, int]]:
    """(inserts, state after them). More of them only lead back to a state reached before."""
    out = [(0, state)]
    while (then := inserted(out[-1][1])) not in [s for _, s in out]:
        out.append((len(out), then))
    return out


def symbol_matrix(symbol: str) -> Matrix:
    matrix: Matrix = [[None] * 4 for _ in STATES]
    kind, extra = symbol.lower(), CUT_OFF if symbol.isupper() else 0
    for start in STATES:
        for count, state in inserts(start):
            edits = [(DELETE, "D", state)]
            if symbol != "x":
                if state in AFTER.get(kind, {}):
                    edits.append((extra, "K", AFTER[kind][state]))
                edits += [(REROLE + extra, "R", AFTER[k][state]) for k in "ua" if state in AFTER[k]]
            for cost, letter, end in edits:
                cell = cost + INSERT * count, "I" * count + letter
                if matrix[start][end] is None or cell < matrix[start][end]:
                    matrix[start][end] = cell
    return matrix


def product(one: Matrix, other: Matrix) -> Matrix:
    out: Matrix = [[None] * 4 for _ in STATES]
    for start in STATES:
        for end in STATES:
            best = None
            for middle in STATES:
                a, b = one[start][middle], other[middle][end]
                if a and b and (best is None or a[0] + b[0] < best[0]
                                or a[0] + b[0] == best[0] and comes_first(a[1], best[1][0])):
                    best = a[0] + b[0], (a[1], b[1])
            out[start][end] = best
    return out


class Grammar:
    """Rules by round, (left, right) to the number of the rule, and the matrix of each symbol and rule."""

    def __init__(self):
        self.rounds: list[dict[tuple[int, int], int]] = []
        self.matrices = [symbol_matrix(s) for s in SYMBOLS]

    def add_round(self, pairs: list[tuple[int, int]]) -> None:
        self.rounds.append({pair: len(self.matrices) + k for k, pair in enumerate(pairs)})
        self.matrices += [product(self.matrices[a], self.matrices[b]) for a, b in pairs]

    def compress(self, symbols: str) -> list[int]:
        sequence = [SYMBOLS.index(s) for s in symbols]
        for rules in self.rounds:
            out, at = [], 0
            while at < len(sequence):
                rule = rules.get((sequence[at], sequence[at + 1])) if at + 1 < len(sequence) else None
                out.append(sequence[at] if rule is None else rule)
                at += 1 if rule is None else 2
            sequence = out
        return sequence

    def matrix(self, symbols: str) -> Matrix:
        return functools.reduce(product, [self.matrices[s] for s in self.compress(symbols)])


def count_pairs(sequence: list[int]) -> Counter:
    """Neighbouring pairs; of overlapping ones of one symbol every other."""
    pairs, skip = Counter(), -1
    for at in range(len(sequence) - 1):
        if sequence[at] == sequence[at + 1] and skip == at:
            continue
        pairs[sequence[at], sequence[at + 1]] += 1
        skip = at + 1
    return pairs


def learn_grammar(sequences: DataFrame) -> Grammar:
    """Rules for (symbols, times): pairs that occur twice or more, the most frequent ones of each round."""
    grammar = Grammar()
    for _ in range(ROUNDS):
        def pairs(batches, grammar=grammar):
            import pandas as pd

            for batch in batches:
                counts = Counter()
                for symbols, times in zip(batch["symbols"], batch["times"], strict=True):
                    for pair, n in count_pairs(grammar.compress(symbols)).items():
                        counts[pair] += n * times
                yield pd.DataFrame([(*p, n) for p, n in counts.items()], columns=["a", "b", "n"])

        counted = (sequences.mapInPandas(pairs, "a int, b int, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))
                   .filter("n > 1").orderBy(F.desc("n"), "a", "b").limit(PAIRS).collect())  # PAIRS rows at most
        if not counted:
            break
        grammar.add_round([(r.a, r.b) for r in counted])
    return grammar


def closing(state: int) -> int:
    """Inserts that end a conversation in ``state`` well."""
    return {1: 2, 2: 1}.get(state, 0)


def best_end(costs: dict[int, int], order: dict[int, int]) -> int:
    """The state to end in: least cost with the closing inserts, then the least letters (see ``product``)."""
    return min(costs, key=lambda s: (costs[s] + INSERT * closing(s), order[s]))


def flat(matrix: Matrix) -> tuple[list[int], list[int]]:
    """Costs, -1 for none, and the place of each cell's letters among those of its row."""
    costs, ranks = [], []
    for row in matrix:
        words = [None if cell is None else "".join(letters(cell[1])) for cell in row]
        known = sorted(w for w in words if w is not None)
        costs += [-1 if cell is None else cell[0] for cell in row]
        ranks += [0 if w is None else known.index(w) for w in words]
    return costs, ranks


def follow(cells: list[tuple[list[int], list[int]]], start: int):
    """Cost and order of the letters per end state, and where each step came from, along ``cells`` from ``start``."""
    cost, order, back = {start: 0}, {start: 0}, []
    for costs, ranks in cells:
        new: dict[int, tuple] = {}
        for state, paid in cost.items():
            for end in STATES:
                if (c := costs[4 * state + end]) >= 0:
                    option = paid + c, order[state], ranks[4 * state + end], state
                    if end not in new or option < new[end]:
                        new[end] = option
        back.append({end: option[3] for end, option in new.items()})
        cost = {end: option[0] for end, option in new.items()}
        order = {end: k for k, end in enumerate(sorted(new, key=lambda e: new[e][1:3]))}
    return cost, order, back


def combined(cells: list[tuple[list[int], list[int]]]) -> tuple[list[int], list[int]]:
    costs, ranks = [], []
    for start in STATES:
        cost, order, _ = follow(cells, start)
        costs += [int(cost.get(end, -1)) for end in STATES]
        ranks += [order.get(end, 0) for end in STATES]
    return costs, ranks


def states_between(cells: list[tuple[list[int], list[int]]], start: int, end: int) -> list[int]:
    """The states before, between and after ``cells`` on the best way from ``start`` to ``end``."""
    states = [end]
    for came_from in reversed(follow(cells, start)[2]):
        states.append(came_from[states[-1]])
    return states[::-1]


def walk_edits(audit: str, state: int, symbols: str):
    """(roles inserted before, letter, new role) of each row, and the roles inserted after the last."""
    rows, before, at = [], [], 0
    for letter in audit:
        if letter == "I":
            state = inserted(state)
            before.append(NAMES[state])
            continue
        role = None
        if letter == "K":
            state = AFTER[symbols[at].lower()][state]
        elif letter == "R":
            state = inserted(state)
            role = NAMES[state]
        rows.append((before, letter, role))
        before, at = [], at + 1
    return rows, before


# ---- on Spark ----------------------------------------------------------------------------------

def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults dealt by the CRC-32 of ``conv_id:turn`` (nulls: one space)."""
    def spaced(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    fault = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    text = (F.when(fault == 1, "").when(fault == 2, F.regexp_replace(spaced("text"), "[.!?]", ""))
            .otherwise(spaced("text")))
    return conversations.filter(fault != 0).select(
        "conv_id", "turn", F.when(fault == 4, "user").otherwise(spaced("role")).alias("role"), text.alias("text"),
        F.explode(F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy")).drop("_copy")


def key_of(conv: str) -> Column:
    """The id as text after a mark, so that a null id has a key too."""
    return F.coalesce(F.concat(F.lit("="), F.col(conv).cast("string")), F.lit(""))


def numbered_rows(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(uid, conv, turn, role, text), written once, so that a row keeps its number."""
    return materialize(conversations.select(
        F.monotonically_increasing_id().alias("uid"), key_of(conv).alias("conv"), F.col(turn).alias("turn"),
        F.coalesce(role, F.lit(" ")).alias("role"), F.coalesce(text, F.lit(" ")).alias("text")))


def row_blocks(rows: DataFrame) -> DataFrame:
    """(conv, block, rows): blocks of up to 2 ** BITS neighbouring rows with (at, uid, kind, fault, symbol), in order."""
    ended = F.rtrim("text", F.lit(SPACE))
    initial = F.substring("role", 1, 1)
    narrow = rows.select(
        "uid", "conv", "turn", "role", F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("kind"),
        F.when(ended == "", "b").when(~F.substring(ended, -1, 1).isin(".", "!", "?"), "t").otherwise("n").alias("fault"),
        F.unhex(F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256)).alias("digest"))
    order = ["conv", F.asc_nulls_first("turn"), "role", "digest", "uid"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = materialize(narrow.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(
        "uid", "conv", "kind", "fault", "digest", F.monotonically_increasing_id().alias("at")))
    firsts = placed.groupBy("conv", "digest").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    fault = F.when((F.col("fault") != "b") & F.col("first").isNull(), "d").otherwise(F.col("fault"))
    judged = placed.join(firsts, "at", "left").withColumn("fault", fault).withColumn(
        "symbol", F.when(F.col("fault").isin("b", "d"), "x").when(F.col("fault") == "t", F.upper("kind")).otherwise(F.col("kind")))
    ordered = F.array_sort(F.collect_list(F.struct("at", "uid", "kind", "fault", "symbol")))
    return materialize(judged.groupBy("conv", F.shiftright("at", BITS).alias("block")).agg(ordered.alias("rows"))
                       .withColumn("symbols", F.array_join("rows.symbol", "")))


@functools.lru_cache(maxsize=1)
def remembered(key: str) -> dict[str, Matrix]:
    """Matrices of the sequences that a worker process met with the grammar ``key``."""
    return {}


def matrix_finder(grammar: Grammar, key: str):
    def find(symbols: str) -> Matrix:
        known = remembered(key)
        if symbols not in known:
            if len(known) >= REMEMBERED:
                known.clear()
            known[symbols] = grammar.matrix(symbols)
        return known[symbols]

    return find


def chosen_states(cells: DataFrame) -> DataFrame:
    """(conv, block, enter, leave) for the blocks (conv, block, costs, ranks) of whole conversations."""
    up = F.shiftright("block", BITS)

    def pairs(pdf):
        pdf = pdf.sort_values("block")
        return pdf, list(zip(pdf["costs"], pdf["ranks"], strict=True))

    def join_up(pdf):
        costs, ranks = combined(pairs(pdf)[1])
        return pdf.iloc[:1][["conv", "above"]].assign(costs=[costs], ranks=[ranks])

    def trace_down(pdf):
        pdf, found = pairs(pdf)
        states = states_between(found, int(pdf["enter"].iloc[0]), int(pdf["leave"].iloc[0]))
        return pdf[["conv", "block"]].assign(enter=states[:-1], leave=states[1:])

    if not has_rows(cells.groupBy("conv").count().filter("count > 1")):
        def ends(batches):
            for batch in batches:
                leave = [best_end(*follow([cell], 0)[:2]) for cell in zip(batch["costs"], batch["ranks"], strict=True)]
                yield batch[["conv", "block"]].assign(enter=0, leave=leave)

        return cells.mapInPandas(ends, "conv string, block bigint, enter int, leave int")
    above = materialize(cells.withColumn("above", up).groupBy("conv", "above").applyInPandas(
        join_up, "conv string, above bigint, costs array<int>, ranks array<int>").withColumnRenamed("above", "block"))
    chosen = chosen_states(above).withColumnRenamed("block", "above")
    return materialize(cells.withColumn("above", up).join(chosen, ["conv", "above"]).groupBy("conv", "above").applyInPandas(
        trace_down, "conv string, block bigint, enter int, leave int"))


def solved_blocks(blocks: DataFrame) -> DataFrame:
    """Per block its counts, cost, audit, and the edits of its rows in order."""
    grammar = learn_grammar(materialize(blocks.groupBy("symbols").agg(F.count(F.lit(1)).alias("times"))))
    find = matrix_finder(grammar, uuid.uuid4().hex)

    def cells(batches):
        for batch in batches:
            found = [flat(find(s)) for s in batch["symbols"]]
            yield batch[["conv", "block"]].assign(costs=[f[0] for f in found], ranks=[f[1] for f in found])

    def solve(batches):
        import pandas as pd

        for batch in batches:
            out = []
            for b in batch.itertuples(index=False):
                matrix, enter = find(b.symbols), 0
                if b.n_blocks > 1:
                    enter, leave = int(b.enter), int(b.leave)
                else:
                    leave = best_end(*follow([flat(matrix)], 0)[:2])
                cost, rope = matrix[enter][leave]
                closes = closing(leave) if b.block == b.last else 0
                audit = "".join(letters(rope)) + "I" * closes
                edits, after = walk_edits(audit, enter, b.symbols)
                kinds, faults = b.kinds, Counter(b.faults)
                out.append((b.conv, b.block, b.n_blocks, faults["b"], faults["d"], faults["t"],
                            sum(kinds[k:k + 2] not in ("su", "ua", "au") for k in range(len(kinds) - 1)),
                            kinds[0], kinds[-1], cost + INSERT * closes, audit,
                            [{"at": a, "uid": u, "before": before, "edit": letter, "role": role,
                              "after": after if k == len(edits) - 1 else []}
                             for k, (a, u, (before, letter, role)) in enumerate(zip(b.ats, b.uids, edits, strict=True))]))
            yield pd.DataFrame(out, columns=fields)

    schema = ("conv string, block bigint, n_blocks bigint, blank bigint, duplicate bigint, truncated bigint, "
              "illegal bigint, first_kind string, last_kind string, cost bigint, audit string, edits array<struct<"
              "at:bigint,uid:bigint,before:array<string>,edit:string,role:string,after:array<string>>>")
    fields = [f.split()[0] for f in schema.split(", ")[:12]]
    sizes = blocks.groupBy("conv").agg(F.count(F.lit(1)).alias("n_blocks"), F.max("block").alias("last"))
    sized = blocks.join(sizes, "conv")
    several = materialize(sized.filter("n_blocks > 1").select("conv", "block", "symbols").mapInPandas(
        cells, "conv string, block bigint, costs array<int>, ranks array<int>"))
    planned = sized.join(chosen_states(several), ["conv", "block"], "left")
    return materialize(planned.select(
        "conv", "block", "n_blocks", "last", "symbols", "enter", "leave", F.col("rows.at").alias("ats"),
        F.col("rows.uid").alias("uids"), F.array_join("rows.kind", "").alias("kinds"),
        F.array_join("rows.fault", "").alias("faults")).mapInPandas(solve, schema))


def row_edits(rows: DataFrame, solved: DataFrame) -> DataFrame:
    """Every row with its place and edit: (conv, block, n_blocks, at, before, edit, new_role, after, turn, role, text)."""
    edits = solved.select("block", "n_blocks", F.explode("edits").alias("e")).select(
        "block", "n_blocks", "e.at", "e.uid", "e.before", "e.edit", F.col("e.role").alias("new_role"), "e.after")
    return rows.join(edits, "uid")


def repaired_rows(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                  text: str = "text") -> DataFrame:
    """The rows of the repaired conversations: id, place (at, part), role and text; inserted ones have no turn."""
    rows = numbered_rows(conversations, conv, turn, role, text)
    empty = F.lit(None).cast(dict(rows.dtypes)["turn"])

    def added(names: Column) -> Column:
        return F.transform(names, lambda n: F.struct(empty.alias(turn), n.alias(role), F.lit("").alias(text)))

    own = F.filter(F.array(F.when(F.col("edit") != "D", F.struct(
        F.col("turn").alias(turn), F.coalesce("new_role", "role").alias(role), F.col("text").alias(text)))), lambda r: r.isNotNull())
    lines = F.concat(added(F.col("before")), own, added(F.col("after")))
    back = F.when(F.col("conv") != "", F.substring("conv", 2, 1 << 30)).cast(dict(conversations.dtypes)[conv])
    return row_edits(rows, solved_blocks(row_blocks(rows))).select(
        back.alias(conv), "at", F.posexplode(lines).alias("part", "row")).select(conv, "at", "part", "row.*")


def streamed(blocks: DataFrame) -> DataFrame:
    """The report of conversations of several blocks, read one after the other."""
    def read(batches):
        import hashlib

        import pandas as pd

        def told(conv, total):
            row = (conv, *total["sums"], "".join(total["audit"]), total["hash"].hexdigest())
            return pd.DataFrame([row], columns=["conv", *sums, "audit", "repaired_sha256"])

        now, total = None, None
        for batch in batches:
            for b in batch.itertuples(index=False):
                if b.conv != now:
                    if total is not None:
                        yield told(now, total)
                    now, total = b.conv, {"sums": [0] * len(sums), "audit": [], "hash": hashlib.sha256(), "kind": None, "any": False}
                total["sums"] = [t + getattr(b, s) for t, s in zip(total["sums"], sums, strict=True)]
                if total["kind"] is not None and total["kind"] + b.first_kind not in ("su", "ua", "au"):
                    total["sums"][sums.index("illegal")] += 1
                total["kind"] = b.last_kind
                total["audit"].append(b.audit)
                if b.lines:
                    total["hash"].update((("\n" if total["any"] else "") + b.lines).encode())
                    total["any"] = True
        if total is not None:
            yield told(now, total)

    sums = ["blank", "duplicate", "truncated", "illegal", "cost"]
    parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return blocks.repartition(parts, "conv").sortWithinPartitions("conv", "block").mapInPandas(
        read, "conv string, " + ", ".join(f"{s} bigint" for s in sums) + ", audit string, repaired_sha256 string")


def report(conversations: DataFrame, all_ids: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
           text: str = "text") -> DataFrame:
    """One row per id of ``all_ids``: gaps, faults, the cheapest repair and the digest of the repaired conversation."""
    rows = numbered_rows(conversations, conv, turn, role, text)
    solved = solved_blocks(row_blocks(rows))
    line = F.when(F.col("edit") != "D", F.concat(F.coalesce("new_role", "role"), F.lit(":"), "text"))
    lines = F.concat(F.transform("before", lambda n: F.concat(n, F.lit(":"))),
                     F.filter(F.array(line), lambda x: x.isNotNull()), F.transform("after", lambda n: F.concat(n, F.lit(":"))))
    pieces = row_edits(rows, solved).select("conv", "block", "at", lines.alias("lines")).filter("size(lines) > 0")
    ordered = F.array_sort(F.collect_list(F.struct("at", "lines")))
    texts = pieces.groupBy("conv", "block").agg(F.array_join(F.flatten(ordered["lines"]), "\n").alias("lines"))
    whole = (solved.drop("edits").join(texts, ["conv", "block"], "left")
             .withColumn("lines", F.coalesce("lines", F.lit(""))))
    told = ["conv", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    found = (whole.filter("n_blocks = 1").withColumn("repaired_sha256", F.sha2("lines", 256)).select(*told)
             .unionByName(streamed(whole.filter("n_blocks > 1"))))
    turns = rows.groupBy("conv", "turn").agg(F.lit(1).alias("one")).groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("bigint").alias("gaps"))
    ids = all_ids.select(F.col(conv).alias("id"), key_of(conv).alias("conv")).distinct()
    joined = ids.join(turns, "conv", "left").join(found, "conv", "left")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return joined.select(
        F.col("id").alias(conv), *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
