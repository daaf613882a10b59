"""Conversation structure repair: the cheapest edits, found along a trie of role and fault signatures.

Method. Each conversation becomes a signature, a byte for each row in order: initial of
its role and first fault. Signatures are sorted by ranges, so that equal ones and those
with one beginning meet in a task. There a prefix trie takes them in order: a node holds
the layer of the dynamic program after its prefix (for each state of the wanted form the
least cost and the rank of its edits among the states'), computed once for all signatures
below it; at the terminal node the answer is read off by walking back to the root. As
signatures arrive sorted, only the path to the newest node is kept.

States: nothing kept (0), after the system row (1), after a user (2), after an assistant
(3); 0 and 3 may end. The edits that lead to a layer's states end with a row's own edit
and hold equally many of these, so none begins with another and their ASCII order within
a layer is a rank of four: ties need no comparing of whole edits.

Rows. Faults are found in the JVM: repeated rows by a window over the digest of role and
text. The repaired rows are written by streaming each conversation's rows, sorted, behind
its answer. No task holds a conversation's texts: it holds a byte and two references for
each of its rows. A conversation itself is one task's work, since a digest over its rows
in order is asked for.

Semantics. A null role or text is one space. Rows are ordered by turn, nulls first; rows of
one turn by role and then by the text's digest. A null conv_id is a conversation of its
own. Roles count by their first letter; an empty role has none and
can't stay as it is. Columns other than
conv_id, turn, role and text are ignored, whatever their names. An empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import itertools
from array import array
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, record_batches, small_batches, table, utf8

BLANK_CHARS = " \t\n\x0b\x0c\r"
INITIALS = "sua"
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
NEVER = 1 << 40
#: Costs of the edits, by their initials.
COST = {"D": 3, "I": 2, "K": 0, "R": 2}
#: State after one more user or assistant row, by state; and what that row's role is.
GROWN = (2, 2, 3, 2)
ROLE = ("user", "user", "assistant", "user")
#: State after keeping a row, by state and initial.
KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
LEGAL = {"su", "ua", "au"}
#: Inserts still needed for an end, by state.
MISSING = (0, 2, 1, 0)


class Layer(NamedTuple):
    """For each state: cost above the layer's least, and rank of its edits among the states' in ASCII order."""

    costs: tuple[int, int, int, int]
    ranks: tuple[int, int, int, int]


class Step(NamedTuple):
    """A layer, how much its least cost rose, and for each state the state before and the edits since."""

    layer: Layer
    rise: int
    back: tuple


START = Step(Layer((0, NEVER, NEVER, NEVER), (0, 4, 4, 4)), 0, ())


@lru_cache(maxsize=None)  # layers are relative and lose what can't win, so there are few
def advance(layer: Layer, code: int) -> Step:
    """The layer after one more row."""
    initial, fault = (INITIALS + "-")[code // 4], code % 4
    best: list[tuple | None] = [None] * 4

    def offer(state: int, cost: int, rank: int, edits: str, origin: int):
        if best[state] is None or (cost, rank, edits) < best[state][:3]:
            best[state] = (cost, rank, edits, origin)

    for origin, (cost, rank) in enumerate(zip(*layer, strict=True)):
        if cost >= NEVER:
            continue
        state, edits = origin, ""
        for _ in range(3):  # a third insert leads to a state where the first did
            offer(state, cost + COST["D"], rank, edits + "D", origin)
            if fault in (SOUND, TRUNCATED):
                stays = cost + (fault == TRUNCATED)
                offer(GROWN[state], stays + COST["R"], rank, edits + "R", origin)
                if (kept := KEPT.get((state, initial))) is not None:
                    offer(kept, stays + COST["K"], rank, edits + "K", origin)
            state, edits, cost = GROWN[state], edits + "I", cost + COST["I"]
    costs = [b[0] if b else NEVER for b in best]
    # what another state can do as well for less is no part of a cheapest repair
    none, system, user, assistant = costs
    if none > min(assistant + COST["D"], user + COST["I"] + COST["D"]):
        costs[0] = NEVER
    if system > min(assistant, user + COST["I"]):
        costs[1] = NEVER
    if user > assistant + COST["I"]:
        costs[2] = NEVER
    if assistant > user + COST["I"]:
        costs[3] = NEVER
    least = min(costs)
    order = sorted((s for s in range(4) if costs[s] < NEVER), key=lambda s: best[s][1:3])
    ranks = tuple(order.index(s) if s in order else 4 for s in range(4))
    return Step(Layer(tuple(c - least if c < NEVER else NEVER for c in costs), ranks), least, tuple((b[3], b[2]) if b else None for b in best))


class Answer(NamedTuple):
    blank: int
    duplicate: int
    truncated: int
    illegal: int
    cost: int
    audit: str


class Trie:
    """The path from the root to the signature inserted last; signatures come sorted, so no other node is visited again."""

    def __init__(self):
        self.codes = b""
        self.steps = [START]
        self.sums = [array("q", [0]) for _ in range(5)]  # at each node: blank, duplicate, truncated, illegal, cost

    def insert(self, signature: bytes) -> Answer:
        shared = self.shared(signature)
        del self.steps[shared + 1 :]
        for held in self.sums:
            del held[shared + 1 :]
        blank, duplicate, truncated, illegal, cost = self.sums
        for at in range(shared, len(signature)):
            code = signature[at]
            step = advance(self.steps[-1].layer, code)
            self.steps.append(step)
            fault = code % 4
            blank.append(blank[-1] + (fault == BLANK))
            duplicate.append(duplicate[-1] + (fault == DUPLICATE))
            truncated.append(truncated[-1] + (fault == TRUNCATED))
            pair = (INITIALS + "-")[signature[at - 1] // 4] + (INITIALS + "-")[code // 4] if at else "su"
            illegal.append(illegal[-1] + (pair not in LEGAL))
            cost.append(cost[-1] + step.rise)
        self.codes = signature
        return self.answer()

    def shared(self, signature: bytes) -> int:
        """Length of the common prefix with the signature inserted last."""
        low, high = 0, min(len(signature), len(self.codes))
        while low < high:
            half = (low + high + 1) // 2
            if signature[low:half] == self.codes[low:half]:
                low = half
            else:
                high = half - 1
        return low

    def answer(self) -> Answer:
        costs, ranks = self.steps[-1].layer
        more, _, state = min((costs[s] + COST["I"] * MISSING[s], ranks[s], s) for s in range(4))
        edits = ["I" * MISSING[state]]
        for step in reversed(self.steps[1:]):
            state, own = step.back[state]
            edits.append(own)
        return Answer(*(held[-1] for held in self.sums[:4]), self.sums[4][-1] + more, "".join(reversed(edits)))


def plain(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, with one space for a null role or text."""
    return conversations.select("conv_id", "turn", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")))


def damage(conversations: DataFrame) -> DataFrame:
    """The conversations with a fifth of their rows damaged, by the checksum of conversation and turn."""
    spelt = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kind = F.crc32(spelt.cast("binary")) % 20
    rows = plain(conversations).withColumn("kind", kind).filter("kind != 0")
    rows = rows.withColumn("text", F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
    rows = rows.withColumn("role", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")))
    times = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.withColumn("copy", F.explode(times)).drop("kind", "copy")


def digest():
    """Of role and text, to compare whole rows by and to order those of one turn."""
    return F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256))


def in_order() -> list:
    return ["conv_id", F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("digest").asc_nulls_first()]


def coded(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """conv_id, turn and code (initial and first fault) of each row, a conversation's rows together and in order.

    ``ids`` are conversations that count even without rows; they come as rows without code.
    """
    body = F.rtrim(F.col("text"), F.lit(BLANK_CHARS))
    initial = F.coalesce(*(F.when(F.substring("role", 1, 1) == c, i) for i, c in enumerate(INITIALS)), F.lit(len(INITIALS)))
    own = rows.select("conv_id", "turn", "role", digest().alias("digest"), initial.alias("initial"), (body == "").alias("blank"), (~F.substring(body, -1, 1).isin(".", "!", "?")).alias("cut"))
    if ids is not None:
        empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in own.schema.fields if f.name != "conv_id"]
        own = own.union(ids.select("conv_id").distinct().select("conv_id", *empty))
    own = own.repartition("conv_id")
    again = F.row_number().over(Window.partitionBy("conv_id", "digest").orderBy(F.col("turn").asc_nulls_first())) > 1
    fault = F.when(F.col("blank"), BLANK).when(again, DUPLICATE).when(F.col("cut"), TRUNCATED).otherwise(SOUND)
    return own.withColumn("code", F.col("initial") * 4 + fault).sortWithinPartitions(*in_order()).select("conv_id", "turn", "code")


def peeked(batches):
    """The Arrow type of the first column, and all rows as tuples; None if there are no rows."""
    batches = (b for b in batches if len(b))
    first = next(batches, None)
    if first is None:
        return None
    return first.column(0).type, (row for b in itertools.chain([first], batches) for row in zip(*(c.to_pylist() for c in b.columns), strict=True))


def signatures(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """conv_id, gaps, signature of each conversation."""
    source = coded(rows, ids)
    schema = T.StructType([source.schema["conv_id"], T.StructField("gaps", T.LongType()), T.StructField("signature", T.BinaryType())])

    def run(batches):
        batches = peeked(batches)
        if batches is None:
            return
        kind, stream = batches

        def walk():
            now, codes, turns, first, last, begun = None, bytearray(), 0, None, None, False
            for conv, turn, code in stream:
                if not begun or conv != now:
                    if begun:
                        yield now, last - first + 1 - turns if turns else 0, bytes(codes)
                    now, codes, turns, first, last, begun = conv, bytearray(), 0, None, None, True
                if code is None:
                    continue
                codes.append(code)
                if turn is not None and turn != last:
                    first, last, turns = turn if first is None else first, turn, turns + 1
            yield now, last - first + 1 - turns if turns else 0, bytes(codes)

        yield from record_batches(walk(), pa.schema([("conv_id", kind), ("gaps", pa.int64()), ("signature", pa.binary())]))

    return source.mapInArrow(run, schema)


def audits(rows: DataFrame, scratch: Scratch, ids: DataFrame | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of each conversation."""
    held = scratch.keep(signatures(rows, ids), "signatures")
    dealt = held.repartitionByRange("signature", F.xxhash64("conv_id")).sortWithinPartitions("signature")
    numbers = ("blank", "duplicate", "truncated", "illegal", "cost")
    schema = T.StructType([*held.schema.fields[:2], *(T.StructField(c, T.LongType()) for c in numbers), T.StructField("audit", T.StringType())])

    def run(batches):
        trie = Trie()
        for batch in batches:
            answers = [trie.insert(s) for s in batch.column(2).to_pylist()]
            *counts, edits = zip(*answers, strict=True) if answers else [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in counts), pa.array(edits, pa.string())], names=schema.names)

    return dealt.mapInArrow(run, schema)


def rewritten(stream):
    """Walks conversations, each behind its answer: (conv_id, answer, audit, repaired rows) with the rows as (edit, role, text).

    The rows are a generator that has to be used up before the next conversation.
    """
    waiting = next(stream, None)
    while waiting is not None:
        conv, _, audit, answer = waiting

        def rows(audit=audit):
            nonlocal waiting
            state = at = 0

            def inserts():
                nonlocal state, at
                while at < len(audit) and audit[at] == "I":
                    yield "I", ROLE[state], ""
                    state, at = GROWN[state], at + 1

            waiting = next(stream, None)
            while waiting is not None and waiting[3] is None:
                yield from inserts()
                edit, role = audit[at], waiting[1]
                at += 1
                if edit == "R":
                    role, state = ROLE[state], GROWN[state]
                elif edit == "K":
                    state = KEPT[state, role[:1]]
                if edit != "D":
                    yield edit, role, waiting[2]
                waiting = next(stream, None)
            yield from inserts()

        yield conv, answer, audit, rows()


def behind_answers(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """The rows of each conversation in order behind its answer; the answer's text is the audit."""
    numbers = [c for c in answers.columns if c not in ("conv_id", "audit")]
    answer = F.struct(*numbers)
    heads = answers.select("conv_id", F.lit(None).cast("string").alias("role"), F.col("audit").alias("text"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.lit(None).cast("binary").alias("digest"), answer.alias("answer"))
    bodies = rows.select("conv_id", "role", "text", "turn", digest().alias("digest"))
    both = heads.unionByName(bodies, allowMissingColumns=True).repartition("conv_id")
    key, *rest = in_order()
    return both.sortWithinPartitions(key, F.col("answer").isNull(), *rest).select("conv_id", "role", "text", "answer")


def repair(conversations: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place (from 0), edit (K, R or I), role, text. Deleted rows are left out."""
    rows = plain(conversations)
    source = behind_answers(rows, audits(rows, Scratch(rows.sparkSession, "conversations")))
    schema = T.StructType([rows.schema["conv_id"], T.StructField("place", T.LongType()), *(T.StructField(c, T.StringType()) for c in ("edit", "role", "text"))])

    def run(batches):
        if (found := peeked(batches)) is not None:
            kind, stream = found
            rows = ((conv, place, *row) for conv, _, _, own in rewritten(stream) for place, row in enumerate(own))
            yield from record_batches(rows, pa.schema([("conv_id", kind), ("place", pa.int64()), *((c, pa.string()) for c in ("edit", "role", "text"))]))

    return source.mapInArrow(run, schema)


def digests(conversations: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """What ``audits`` gives, with the SHA-256 of the repaired rows (``role:text``, joined by line ends)."""
    rows = plain(conversations)
    answers = audits(rows, Scratch(rows.sparkSession, "conversations"), ids)
    source = behind_answers(rows, answers)
    numbers = [c for c in answers.columns if c not in ("conv_id", "audit")]
    schema = T.StructType([rows.schema["conv_id"], *(T.StructField(c, T.LongType()) for c in numbers), T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])

    def run(batches):
        def digested(stream):
            for conv, answer, audit, own in rewritten(stream):
                digest = hashlib.sha256()
                for place, (_, role, text) in enumerate(own):
                    digest.update(utf8(("\n" if place else "") + f"{role}:{text}"))
                yield conv, *(answer[c] for c in numbers), audit, digest.hexdigest()

        if (found := peeked(batches)) is not None:
            kind, stream = found
            yield from record_batches(digested(stream), pa.schema([("conv_id", kind), *((c, pa.int64()) for c in numbers), ("audit", pa.string()), ("repaired_sha256", pa.string())]))

    return source.mapInArrow(run, schema)


def op12_conversation_repair(spark, sf_dir):
    small_batches(spark)
    conversations = table(spark, sf_dir, "conversations")
    return digests(damage(conversations), ids=conversations)


def _plus(state: str, cost: int | str, edits: str) -> str:
    """SQL: a state (five digits of cost, then its edits) after more edits."""
    return f"(lpad((left({state}, 5)::INT + {cost})::VARCHAR, 5, '0') || substr({state}, 6) || '{edits}')"


def _kept(state: str, initial: str) -> str:
    return f"CASE WHEN sound AND initial = '{initial}' THEN {_plus(state, 'cut', 'K')} END"


def _reroled(state: str) -> str:
    return f"CASE WHEN sound THEN {_plus(state, '2 + cut', 'R')} END"


#: The same in DuckDB: a layer of four states for each row by recursion, edits compared as whole texts.
SQL = rf"""
WITH RECURSIVE bits AS (SELECT i, list_reduce(list_concat([i::BIGINT], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS crc FROM range(256) t(i)),
crcs AS (SELECT list(crc ORDER BY i) AS entry FROM bits),
spelt AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))) AS digits FROM conversations),
marked AS (
  SELECT * EXCLUDE (digits), xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(0, length(digits) // 2), lambda i: ('0x' || substr(digits, 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(c // 256, entry[xor(c % 256, b) + 1])), 4294967295::BIGINT) % 20 AS kind
  FROM spelt, crcs),
damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM marked, LATERAL (SELECT unnest(CASE kind WHEN 3 THEN [1, 2] ELSE [1] END) AS copy) WHERE kind != 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || text)) AS place,
    rtrim(text, e' \t\n\x0b\x0c\r') AS body FROM damaged),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 AS again, left(role, 1) AS initial FROM placed),
coded AS (
  SELECT conv_id, turn, role, text, place, initial, body = '' AS blank, body != '' AND again AS duplicate, body != '' AND NOT again AND right(body, 1) NOT IN ('.', '!', '?') AS truncated,
    body != '' AND NOT again AS sound, (body != '' AND NOT again AND right(body, 1) NOT IN ('.', '!', '?'))::INT AS cut,
    place > 1 AND (lag(initial) OVER (PARTITION BY conv_id ORDER BY place) || initial) NOT IN ('su', 'ua', 'au') AS illegal
  FROM seen),
layer(conv_id, place, c0, c1, c2, c3) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, '00000', NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR FROM conversations
  UNION ALL
  SELECT conv_id, place, {_plus("k0", 3, "D")}, least({_plus("k1", 3, "D")}, {_kept("k0", "s")}),
    least({_plus("k2", 3, "D")}, {", ".join(f"{_reroled(k)}, {_kept(k, 'u')}" for k in ("k0", "k1", "k3"))}),
    least({_plus("k3", 3, "D")}, {_reroled("k2")}, {_kept("k2", "a")})
  FROM (
    SELECT r.*, c0 AS k0, c1 AS k1, least(c2, {", ".join(_plus(c, 2, "I") for c in ("c0", "c1", "c3"))}) AS k2, least(c3, {_plus("c2", 2, "I")}, {_plus("c0", 4, "II")}, {_plus("c1", 4, "II")}) AS k3
    FROM layer JOIN coded r ON r.conv_id IS NOT DISTINCT FROM layer.conv_id AND r.place = layer.place + 1)),
best AS (
  SELECT conv_id, substr(answer, 6) AS audit, left(answer, 5)::BIGINT AS cost FROM (
    SELECT conv_id, arg_max(least(c0, c3, {_plus("c2", 2, "I")}, {_plus("c1", 4, "II")}), place) AS answer FROM layer GROUP BY conv_id)),
edits AS (
  SELECT conv_id, spot, substr(audit, spot, 1) AS edit, spot - length(replace(left(audit, spot), 'I', '')) AS inserted
  FROM best, LATERAL (SELECT unnest(range(1, length(audit) + 1)) AS spot)),
staying AS (
  SELECT e.conv_id, spot, edit, role, text, row_number() OVER (PARTITION BY e.conv_id ORDER BY spot) AS nth,
    max((edit = 'K' AND initial = 's')::INT) OVER (PARTITION BY e.conv_id ORDER BY spot ROWS UNBOUNDED PRECEDING) AS opened
  FROM edits e LEFT JOIN coded r ON r.conv_id IS NOT DISTINCT FROM e.conv_id AND r.place = spot - inserted AND edit != 'I' WHERE edit != 'D'),
repaired AS (
  SELECT conv_id, sha256(string_agg(CASE edit WHEN 'K' THEN role ELSE CASE WHEN (nth - coalesce(opened, 0)) % 2 = 1 THEN 'user' ELSE 'assistant' END END || ':' || CASE edit WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY spot)) AS repaired_sha256
  FROM staying GROUP BY conv_id),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
    count(*) FILTER (truncated) AS truncated, count(*) FILTER (illegal) AS illegal FROM coded GROUP BY conv_id)
SELECT b.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  cost, audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM best b LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM b.conv_id
"""
