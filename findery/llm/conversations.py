"""Conversation structure repair by a grammar-compressed dynamic program.

Rows become symbols of role and fault, in order; a conversation is cut into blocks of bounded length, so
one may hold a third of all rows. Re-Pair names frequent neighbours among the distinct blocks by new
symbols. Every symbol has one min-plus transfer matrix between the states of the role grammar, whose
entries are a cost and the rope of the edits that reach it; a rule's matrix is the product of its two
halves, made once, bottom-up, and used by all conversations. Texts take no part until the edits are known
and move once: blocks and texts of a conversation meet in one sorted stream.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ByteType, IntegerType, LongType, StringType, StructField, StructType

from findery.llm.common import fold_texts, stage

#: Blanks and the ASCII white space of TAB to CR.
BLANKS = " \t\n\v\f\r"
#: Symbols of a block.
BLOCK = 256
#: Rounds of naming pairs, and the least number of places that a pair must have among the distinct blocks.
PAIR_ROUNDS, LEAST_PLACES = 12, 4
#: First code point of the names of pairs.
FIRST_NAME = 0x4E00
#: Characters of a text by which rows of one turn and role are ordered, before its hash.
LEAD_CHARS = 64

# Costs of the edits, as the contract of the query states them.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
# States of the roles read so far: nothing, system, ends in user, ends in assistant.
STATES = 4
#: (state, initial) to the next state: s?(ua)+.
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ROLES = {"u": "user", "a": "assistant"}
#: Neighbouring initials that are in order.
LEGAL = frozenset(("su", "ua", "au"))

Rope = object  # a str, or (left, right, length)
Matrix = list  # STATES rows of STATES entries: None, or (cost, rope)


def joined(left: Rope, right: Rope) -> Rope:
    return (left, right, _length(left) + _length(right))


def _length(rope: Rope) -> int:
    return len(rope) if isinstance(rope, str) else rope[2]


def flat(rope: Rope) -> str:
    out, todo = [], [rope]
    while todo:
        part = todo.pop()
        if isinstance(part, str):
            out.append(part)
        else:
            todo += (part[1], part[0])
    return "".join(out)


def _first(one: Rope, other: Rope) -> bool:
    """Whether one is not behind the other in ASCII; a left part that both share is never looked at."""
    ends: tuple[list, list] = ([], [])
    pair = [one, other]
    while pair[0] is not pair[1]:
        side = int(_length(pair[1]) > _length(pair[0]))
        if isinstance(pair[side], str):
            side = 1 - side
        if isinstance(pair[side], str):
            ends[0].append(pair[0])
            ends[1].append(pair[1])
            break
        ends[side].append(pair[side][1])
        pair[side] = pair[side][0]
    lines = ["".join(map(flat, reversed(end))) for end in ends]
    return lines[0] <= lines[1]


def better(one: tuple | None, other: tuple | None) -> tuple | None:
    """The cheaper entry; of equal costs the one whose edits come first in ASCII.

    Of equally dear edit strings for the same rows none begins another: the longer would insert more.
    """
    if one is None or other is None:
        return other if one is None else one
    if one[0] != other[0]:
        return one if one[0] < other[0] else other
    return one if _first(one[1], other[1]) else other


def product(left: Matrix, right: Matrix) -> Matrix:
    out: Matrix = [[None] * STATES for _ in range(STATES)]
    for i in range(STATES):
        for k in range(STATES):
            if left[i][k] is not None:
                cost, rope = left[i][k]
                for j in range(STATES):
                    if right[k][j] is not None:
                        out[i][j] = better(out[i][j], (cost + right[k][j][0], joined(rope, right[k][j][1])))
    return out


def _inserts() -> Matrix:
    """No or more inserted rows: walks along user and assistant steps."""
    out: Matrix = [[(0, "") if i == j else None for j in range(STATES)] for i in range(STATES)]
    for start in range(STATES):
        at, cost, edits = start, 0, ""
        for _ in range(2):  # a third one comes back to a state at a cost
            at = next(STEPS[at, r] for r in "ua" if (at, r) in STEPS)
            cost, edits = cost + INSERT, edits + "I"
            out[start][at] = better(out[start][at], (cost, edits))
    return out


INSERTS = _inserts()


def symbol_matrix(symbol: str) -> Matrix:
    """Any inserts and then one row: x must go; s, u, a and o (another role) are capitals when truncated."""
    edit: Matrix = [[None] * STATES for _ in range(STATES)]
    more = TRUNCATED if symbol.isupper() else 0
    for state in range(STATES):
        edit[state][state] = (DELETE, "D")
        for (start, role), end in STEPS.items():
            if start != state or symbol == "x":
                continue
            if role == symbol.lower():
                edit[state][end] = better(edit[state][end], (more, "K"))
            if role in ROLES:
                edit[state][end] = better(edit[state][end], (REROLE + more, "R"))
    return product(INSERTS, edit)


class Grammar:
    """Names of pairs, in the order they were given, and the matrix of every symbol.

    ``rules`` are (pair, name); a name's pair holds symbols and earlier names only.
    """

    def __init__(self, rules: list[tuple[str, str]]):
        self.rules = rules
        self.matrices = {s: symbol_matrix(s) for s in "xsuaoSUAO"}
        for pair, name in rules:
            self.matrices[name] = product(self.matrices[pair[0]], self.matrices[pair[1]])

    def packed(self, symbols: str) -> str:
        for pair, name in self.rules:
            symbols = symbols.replace(pair, name)
        return symbols

    def onward(self, vector: list, symbols: str) -> list:
        """Best entries of the states after a block, from those before it."""
        for name in self.packed(symbols):
            matrix, out = self.matrices[name], [None] * STATES
            for i in range(STATES):
                if vector[i] is not None:
                    cost, rope = vector[i]
                    for j in range(STATES):
                        if matrix[i][j] is not None:
                            out[j] = better(out[j], (cost + matrix[i][j][0], joined(rope, matrix[i][j][1])))
            vector = out
        return vector

    @staticmethod
    def end(vector: list) -> tuple[int, str]:
        """Cost and edits of the best way to a complete conversation, with inserts at its end."""
        best = None
        for i in range(STATES):
            for j in (0, 3):
                if vector[i] is not None and INSERTS[i][j] is not None:
                    best = better(best, (vector[i][0] + INSERTS[i][j][0], joined(vector[i][1], INSERTS[i][j][1])))
        return best[0], flat(best[1])


START = [(0, ""), None, None, None]


def name_pairs(blocks: DataFrame, rounds: int = PAIR_ROUNDS, least: int = LEAST_PLACES) -> Grammar:
    """The grammar of a table of blocks (symbols).

    A round counts the neighbours in all distinct blocks and names the most frequent pairs that share no
    symbol, so that none is in another's way. Counting is a task-wide sum; at most as many pairs as there
    are symbols come to the driver. Fewer names only mean more products for each block, never another result.
    """
    rules: list[tuple[str, str]] = []
    distinct = stage(blocks.select("symbols").distinct(), "conversation-blocks")
    schema = StructType([StructField("pair", StringType()), StructField("n", LongType())])
    for _ in range(rounds):
        packed = Grammar.packed

        class Pairs:
            def __init__(self, known: list[tuple[str, str]] = tuple(rules)):
                self.rules, self.counts = known, Counter()

            def add(self, batch: pa.RecordBatch) -> None:
                for symbols in batch.column("symbols").to_pylist():
                    line = packed(self, symbols)
                    self.counts.update(map("".join, zip(line, line[1:])))

            def rows(self) -> dict:
                return {"pair": list(self.counts), "n": list(self.counts.values())}

        counted = fold_texts(distinct, Pairs, schema).groupBy("pair").agg(F.sum("n").alias("n"))
        found = counted.where(F.col("n") >= least).orderBy(F.desc("n"), "pair").limit(16 + 2 * len(rules)).collect()
        taken: set[str] = set()
        for row in found:
            if not taken & set(row["pair"]):
                taken |= set(row["pair"])
                rules.append((row["pair"], chr(FIRST_NAME + len(rules))))
        if not found:
            break
    return Grammar(rules)


# Rows, faults and blocks.


def rows_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text), whatever else the table holds; a null role or text is one blank."""
    return conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"))


def damage(conversations: DataFrame) -> DataFrame:
    """Rows with faults planted by the CRC-32 of ``conv_id:turn`` (nulls: one blank) modulo 20.

    0 drops the row, 1 empties its text, 2 takes the marks .!? out, 3 repeats it, 4 sets the role user.
    """
    rows = rows_of(conversations)
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn"))) % 20
    rows = rows.withColumn("kind", kind).where("kind != 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, 2).otherwise(1)
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times)))
    return rows.select("conv_id", "turn", "role", "text")


ORDER = ["turn", "role", "lead", "digest"]


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows with the columns that order them inside a conversation."""
    body: Column = F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    return rows.withColumns({"lead": F.substring("text", 1, LEAD_CHARS), "digest": F.unhex(F.sha2(body, 256))})


BLOCK_ROW = StructType([
    StructField("part", IntegerType()), StructField("seq", LongType()), StructField("symbols", StringType()),
    StructField("blank", LongType()), StructField("duplicate", LongType()), StructField("truncated", LongType()),
    StructField("illegal", LongType()), StructField("first", StringType()), StructField("last", StringType()),
    StructField("turns", LongType()), StructField("low", LongType()), StructField("high", LongType()),
])


class _Block:
    """Rows of one conversation in order, summed up."""

    def __init__(self, conv_id: object):
        self.conv_id, self.symbols = conv_id, []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.low = self.high = None

    def add(self, symbol: str, initial: str, turn: int | None) -> None:
        if self.symbols:
            self.illegal += self.last + initial not in LEGAL
        else:
            self.first = initial
        if turn is not None and turn != self.high:
            self.turns += 1
            self.high = turn
            self.low = turn if self.low is None else self.low
        self.last = initial
        self.symbols.append(symbol)


def cut_blocks(rows: DataFrame, size: int = BLOCK) -> DataFrame:
    """Blocks of at most ``size`` rows of a conversation, in order by (part, seq), with what they sum up to.

    Equal rows of one turn are counted first and their first turn is found by a minimum, so that no key gathers
    more than partial sums. What remains is dealt out by ranges of the whole order: a long conversation spreads
    over many tasks, each of which reads its rows as a stream.
    """
    trimmed = F.rtrim("text", F.lit(BLANKS))
    fault = F.when(trimmed == "", "b").when(F.right(trimmed, F.lit(1)).isin(".", "!", "?"), "").otherwise("t")
    initial = F.left("role", F.lit(1))
    keys = ["conv_id", *ORDER]
    groups = stage(
        _keyed(rows).select(*keys, fault.alias("fault"), initial.alias("initial")).groupBy(*keys, "fault", "initial").agg(
            F.count("*").alias("n")), "conversation-rows")
    # a null turn comes first
    firsts = groups.groupBy("conv_id", "role", "lead", "digest").agg(
        F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("at"))
    marks = firsts.select(*[F.col("at.turn").alias(k) if k == "turn" else F.col(k) for k in keys],
                          F.lit(None).cast("string").alias("fault"), F.lit(None).cast("string").alias("initial"),
                          F.lit(0).cast("long").alias("n"), F.lit(True).alias("is_first"))
    marked = groups.withColumn("is_first", F.lit(False)).unionByName(marks).groupBy(*keys).agg(
        F.max("fault").alias("fault"), F.max("initial").alias("initial"), F.sum("n").alias("n"), F.max("is_first").alias("is_first"))
    ordered = marked.repartitionByRange(*keys).sortWithinPartitions(*keys).select(
        "conv_id", "turn", "fault", "initial", "n", "is_first")
    schema = StructType([StructField("conv_id", rows.schema["conv_id"].dataType), *BLOCK_ROW.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, arrow = TaskContext.get().partitionId(), 0, [], to_arrow_schema(schema)
        block: _Block | None = None

        def close() -> None:
            nonlocal seq
            if block is not None and block.symbols:
                held.append({
                    "conv_id": block.conv_id, "part": part, "seq": seq, "symbols": "".join(block.symbols),
                    **{k: getattr(block, k) for k in BLOCK_ROW.names[3:]}})
                seq += 1

        for batch in batches:
            for conv_id, turn, fault, initial, n, is_first in zip(*(c.to_pylist() for c in batch.columns)):
                if block is None or block.conv_id != conv_id:
                    close()
                    block = _Block(conv_id)
                kept = initial if initial in ("s", "u", "a") else "o"
                for copy in range(n):
                    if len(block.symbols) == size:
                        close()
                        block = _Block(conv_id)
                    if fault == "b":
                        block.blank += 1
                        symbol = "x"
                    elif copy or not is_first:
                        block.duplicate += 1
                        symbol = "x"
                    elif fault == "t":
                        block.truncated += 1
                        symbol = kept.upper()
                    else:
                        symbol = kept
                    block.add(symbol, initial, turn)
                    if len(held) >= 4096:
                        yield pa.RecordBatch.from_pylist(held, schema=arrow)
                        held.clear()
        close()
        yield pa.RecordBatch.from_pylist(held, schema=arrow)

    return ordered.mapInArrow(run, schema)


# Blocks and texts of a conversation together.


class _Conversation:
    """Sums, edits and repaired rows of one conversation, read as a stream: its blocks first, then its rows."""

    def __init__(self, conv_id: object, grammar: Grammar, known: dict):
        self.conv_id, self.grammar, self.known = conv_id, grammar, known
        self.sums = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.turns, self.low, self.high, self.last = 0, None, None, None
        self.vector, self.start, self.edits = START, True, None
        self.at, self.state = 0, 0

    def add_block(self, block: dict) -> None:
        for k in self.sums:
            self.sums[k] += block[k]
        if self.last is not None:
            self.sums["illegal"] += self.last + block["first"] not in LEGAL
        self.last = block["last"]
        if block["low"] is not None:
            self.turns += block["turns"] - (block["low"] == self.high)
            self.low = block["low"] if self.low is None else self.low
            self.high = block["high"]
        symbols = block["symbols"]
        if not self.start:
            self.vector = self.grammar.onward(self.vector, symbols)
        else:  # most conversations are one block, and many are alike
            if symbols not in self.known:
                if len(self.known) >= 1 << 16:
                    self.known.clear()
                self.known[symbols] = self.grammar.onward(START, symbols)
            self.vector, self.start = self.known[symbols], False

    def close_blocks(self) -> None:
        if self.edits is None:
            self.cost, self.edits = self.grammar.end(self.vector)

    def _step(self, role: str | None = None) -> str:
        """The initial that the grammar wants next, or takes when a row is kept."""
        wanted = role if role is not None else next(r for r in "ua" if (self.state, r) in STEPS)
        self.state = STEPS[self.state, wanted]
        return wanted

    def _inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.at < len(self.edits) and self.edits[self.at] == "I":
            self.at += 1
            yield "I", ROLES[self._step()], ""

    def add_row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of the repaired rows up to this one."""
        yield from self._inserted()
        edit = self.edits[self.at]
        self.at += 1
        if edit == "K":
            self._step(role[:1])
            yield "K", role, text
        elif edit == "R":
            yield "R", ROLES[self._step()], text

    def rest(self) -> Iterator[tuple[str, str, str]]:
        yield from self._inserted()

    def report(self) -> dict:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return {"conv_id": self.conv_id, "gaps": gaps, **self.sums, "cost": self.cost, "audit": self.edits}


class _Digests:
    """One row per conversation with the digest of its repaired rows."""

    def open(self) -> None:
        self.sha, self.any = hashlib.sha256(), False

    def row(self, conv: _Conversation, edit: str, role: str, text: str) -> None:
        self.sha.update((("\n" if self.any else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
        self.any = True

    def close(self, conv: _Conversation) -> dict:
        return conv.report() | {"repaired_sha256": self.sha.hexdigest()}


REPORT = [StructField(k, LongType()) for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
REPORT += [StructField("audit", StringType()), StructField("repaired_sha256", StringType())]
TURNS = [StructField("position", LongType()), StructField("edit", StringType()), StructField("role", StringType()),
         StructField("text", StringType())]


def _met(rows: DataFrame, ids: DataFrame, turns: bool) -> DataFrame:
    """Blocks and rows of each conversation in one sorted stream, read once."""
    blocks = stage(cut_blocks(rows), "conversation-cuts")
    shared = rows.sparkSession.sparkContext.broadcast(name_pairs(blocks))  # bounded by the rounds of naming
    texts = _keyed(rows)
    everything = (
        ids.select("conv_id").distinct().withColumn("kind", F.lit(0).cast(ByteType()))
        .unionByName(blocks.withColumn("kind", F.lit(1).cast(ByteType())), allowMissingColumns=True)
        .unionByName(texts.withColumn("kind", F.lit(2).cast(ByteType())), allowMissingColumns=True))
    stream = everything.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "part", "seq", *ORDER)
    stream = stream.select("conv_id", "kind", *BLOCK_ROW.names[2:], "role", "text")
    schema = StructType([StructField("conv_id", rows.schema["conv_id"].dataType), *(TURNS if turns else REPORT)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, grammar, known = to_arrow_schema(schema), shared.value, {}
        conv: _Conversation | None = None
        digests, out, size, position = _Digests(), [], 0, 0

        def put(made: Iterator[tuple[str, str, str]]) -> None:
            nonlocal size, position
            for edit, role, text in made:
                if turns:
                    out.append({"conv_id": conv.conv_id, "position": position, "edit": edit, "role": role, "text": text})
                    size += 64 + len(text)
                    position += 1
                else:
                    digests.row(conv, edit, role, text)

        def close() -> None:
            nonlocal size
            if conv is not None:
                conv.close_blocks()
                put(conv.rest())
                if not turns:
                    out.append(digests.close(conv))
                    size += 256 + len(conv.edits)

        for batch in batches:
            columns = {n: batch.column(n).to_pylist() for n in batch.schema.names}
            for i, (conv_id, kind) in enumerate(zip(columns["conv_id"], columns["kind"])):
                if conv is None or conv.conv_id != conv_id:
                    close()
                    conv, position = _Conversation(conv_id, grammar, known), 0
                    digests.open()
                if kind == 1:
                    conv.add_block({k: columns[k][i] for k in BLOCK_ROW.names[2:]})
                elif kind == 2:
                    conv.close_blocks()
                    put(conv.add_row(columns["role"][i], columns["text"][i]))
                if size >= 1 << 22:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)
                    out.clear()
                    size = 0
        close()
        yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return stream.mapInArrow(run, schema)


def repair(conversations: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows are read by turn (nulls first), those of one turn by role, then by the first LEAD_CHARS characters of the
    text, then by its hash. A row's first fault counts: blank (nothing but blanks), duplicate (role and text stood
    earlier), truncated (the last mark is none of .!?). gaps are the turns missing between the smallest and the
    largest, illegal the neighbours whose role initials are not su, ua or au. Edits: Keep costs 0, Rerole to user or
    assistant 2, Delete 3 (blank and duplicate rows must go), Insert of an empty user or assistant row 2; truncated
    rows that stay cost 1. audit are the initials of the cheapest edits after which the role initials read
    ``(s?(ua)+)?``, of equal ones the ASCII-least. repaired_sha256 covers the lines ``role:text`` of the repaired rows.

    A null role or text is one blank; rows of a null conv_id are one conversation; repeated rows are duplicates;
    other columns are never looked at. ``ids`` (conv_id) names conversations to report even without rows: zeros, an
    empty audit, the hash of the empty text. An empty table gives no rows. A hash over a text is made in order, so the
    rows of one conversation pass one task, as a stream; only its edits are held.
    """
    rows = rows_of(conversations)
    return _met(rows, rows if ids is None else ids, turns=False)


def repaired_turns(conversations: DataFrame) -> DataFrame:
    """The rows of the repaired conversations: conv_id, position (from 0), edit (K, R or I), role, text."""
    rows = rows_of(conversations)
    return _met(rows, rows, turns=True)
