"""Conversation structure repair: the cheapest edits that make role order regular, found in layers of rising cost."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quire.llm.common import skew_join, store

#: Rows and bytes of text of a part of a conversation; conversations within one partition and this size are repaired in one go.
ROWS, BYTES = 4096, 4 << 20
#: Parts that are combined at a time.
FAN = 256
#: Costs of the edits, and of a truncated row that stays.
RETITLE, DELETE, INSERT, CUT = 2, 3, 2, 1
#: States of the grammar (s?(ua)+)?, as bits: nothing yet, after s, after u, after a. The first and the last accept.
NOTHING, SYSTEM, USER, ANSWER = 1, 2, 4, 8
STATES = (NOTHING, SYSTEM, USER, ANSWER)
#: Faults of a row.
FAULTS = ("", "blank", "duplicate", "truncated")
#: What ends a conversation from each state: the inserts that lead to an accepting one.
CLOSING = {NOTHING: "", SYSTEM: "II", USER: "I", ANSWER: ""}
SPACE = "\t\n\v\f\r "


def _step(state: int, edit: str, initial: str) -> int:
    """The state after an edit of a row with that role initial (0: not allowed)."""
    if edit == "D":
        return state
    if edit in "IR":
        return ANSWER if state == USER else USER
    if initial == "s":
        return SYSTEM if state == NOTHING else 0
    if initial == "u":
        return USER if state != USER else 0
    return ANSWER if initial == "a" and state == USER else 0


#: For each edit and initial, the set of states before from the set of states after.
BACK = {(e, r): [sum(s for s in STATES if _step(s, e, r) & after) for after in range(16)] for e in "DIKR" for r in "sua?"}


def layers(initials: str, faults: str, goal: int, close: bool = False):
    """The cost of reaching the states `goal` behind the last row from each state before the first: {(row, state): cost}.

    Works from the end. Layer c has for each row the bitset of states from which the goal is reached at cost c and no less; each is made of earlier layers:
    a row kept (0, truncated 1), retitled (2, truncated 3) or deleted (3), or a turn inserted before it (2). With `close`, turns may be inserted behind the last row too, and the first layer that has
    the state NOTHING before the first row is the last: its number is the cost. Without, layers go on until every state before the first row is reached that can be.
    `faults`: a digit for each row, by FAULTS.
    """
    n = len(initials)
    seen = [0] * (n + 1)
    cost: dict[tuple[int, int], int] = {}
    waiting: list[dict[int, int]] = [{n: goal}]
    # From a state only itself and what follows it can be reached; the start is reached from itself alone.
    wanted = NOTHING if close else 15 if goal & (USER | ANSWER) else NOTHING | SYSTEM if goal & SYSTEM else NOTHING
    c = 0
    while c < len(waiting):
        layer = waiting[c]
        while layer:
            i, bits = layer.popitem()
            bits &= ~seen[i]
            if not bits:
                continue
            seen[i] |= bits
            for s in STATES:
                if s & bits:
                    cost[i, s] = c
            into = [(i, BACK["I", "?"][bits], INSERT)] if close or i < n else []
            if i:
                r, fault = initials[i - 1], faults[i - 1]
                r = r if r in "sua" else "?"
                into.append((i - 1, bits, DELETE))
                if fault in "03":
                    more = CUT if fault == "3" else 0
                    into += [(i - 1, BACK["K", r][bits], more), (i - 1, BACK["R", r][bits], RETITLE + more)]
            for at, before, price in into:
                before &= ~seen[at]
                if before:
                    while len(waiting) <= c + price:
                        waiting.append({})
                    waiting[c + price][at] = waiting[c + price].get(at, 0) | before
        if seen[0] & wanted == wanted:
            break
        c += 1
    return cost


def trace(initials: str, faults: str, start: int, cost: dict) -> str:
    """The ASCII-least edits of the least cost from state `start`, by the costs of layers()."""
    out, i, state, n = [], 0, start, len(initials)
    while i < n or cost[i, state]:
        left = cost[i, state]
        r = initials[i] if i < n and initials[i] in "sua" else "?"
        more = CUT if i < n and faults[i] == "3" else 0
        for edit, price, to in (("D", DELETE, i + 1), ("I", INSERT, i), ("K", more, i + 1), ("R", RETITLE + more, i + 1)):
            if edit in "KR" and (i == n or faults[i] in "12"):
                continue
            after = _step(state, edit, r)
            if after and cost.get((to, after)) == left - price:
                out.append(edit)
                i, state = to, after
                break
    return "".join(out)


def cheapest(initials: str, faults: str) -> tuple[int, str]:
    """(cost, audit) of a whole conversation."""
    cost = layers(initials, faults, NOTHING | ANSWER, close=True)
    return cost[0, NOTHING], trace(initials, faults, NOTHING, cost)


def edits_between(initials: str, faults: str) -> dict[tuple[int, int], tuple[int, str]]:
    """For each pair of states before and after the rows the least cost and its ASCII-least edits, without inserts behind the last row."""
    out = {}
    for goal in STATES:
        cost = layers(initials, faults, goal)
        for s in STATES:
            if (0, s) in cost:
                out[s, goal] = (cost[0, s], trace(initials, faults, s, cost))
    return out


def repaired(start: int, edits: str, rows) -> list[tuple[str, str]]:
    """(role, text) of the rows after the edits. `rows`: (role, text)."""
    out, state, rows = [], start, iter(rows)
    for edit in edits:
        role, text = next(rows) if edit != "I" else ("?", "")
        state = _step(state, edit, role[:1] if role[:1] in ("s", "u", "a") else "?")
        if edit != "D":
            out.append((role if edit == "K" else "user" if state == USER else "assistant", text))
    return out


def best_end(between: dict[tuple[int, int], tuple[int, object]]) -> tuple[int, object, int]:
    """(cost, edits or rank, end state) of a whole conversation: the least cost with its closing inserts, then the least edits."""
    found = [(c + INSERT * len(CLOSING[t]), e, CLOSING[t], t) for (s, t), (c, e) in between.items() if s == NOTHING]
    cost, edits, _, end = min(found)
    return cost, edits, end


def joined(parts: list[dict[tuple[int, int], tuple[int, object]]]):
    """Combine parts in a row: ({(state, state): (cost, rank)}, {(state, state): states between the parts}).

    As no list of edits between two states is the beginning of another (each ends with the edit of its part's last row), lists are compared
    part by part, and their ranks within a part stand for them.
    """
    best = {(s, s): (0, (), (s,)) for s in STATES}
    for part in parts:
        ranks = {e: i for i, e in enumerate(sorted({e for _, e in part.values()}))}
        after: dict = {}
        for (s, m), (c, key, path) in best.items():
            for (x, t), (d, e) in part.items():
                if x == m:
                    new = (c + d, (*key, ranks[e]), (*path, t))
                    if (s, t) not in after or new < after[s, t]:
                        after[s, t] = new
        best = after
    ranks = {key: i for i, key in enumerate(sorted({key for _, key, _ in best.values()}))}
    return {k: (c, ranks[key]) for k, (c, key, _) in best.items()}, {k: path for k, (_, _, path) in best.items()}


def tagged(texts: list[tuple[str, str]], seen) -> str:
    """The fault of each row as a digit; `seen` is the set of (role, text) so far and grows."""
    out = []
    for role, text in texts:
        bare = text.rstrip(SPACE)
        if not bare:
            out.append("1")
        elif (role, text) in seen:
            out.append("2")
        else:
            out.append("0" if bare[-1] in ".!?" else "3")
        seen.add((role, text))
    return "".join(out)


def illegal_pairs(initials: str) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows `conv`, `turn`, `role`, `text` with known damage, decided by crc32 of `<conv>:<turn>` modulo 20.

    0 drops the row, 1 empties its text, 2 takes `[.!?]` out of it, 3 gives it twice, 4 makes its role user. Nulls stand for one space, in the checksum too, but conv and turn stay null.
    """
    named = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    d = F.crc32(F.concat(as_text("conv"), F.lit(":"), as_text("turn")).cast("binary")) % 20
    text_ = F.when(d == 1, "").when(d == 2, F.regexp_replace(as_text("text"), "[.!?]", "")).otherwise(as_text("text"))
    out = named.where(d != 0).select("conv", "turn", F.when(d == 4, "user").otherwise(as_text("role")).alias("role"), text_.alias("text"), F.when(d == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("_twice"))
    return out.select("conv", "turn", "role", "text", F.explode("_twice").alias("_copy")).drop("_copy")


def _parts(rows: DataFrame, most: int) -> DataFrame:
    """Conversations, whole or in parts, from rows in order over all partitions.

    Rows are dealt out by ranges of conversation and turn, so a conversation of any size lies over as many partitions as it needs. A task
    repairs the conversations that begin and end within it (`whole`, with their results); of the first and the last one, which may go on elsewhere, and of those over `most` rows or
    BYTES it hands on parts: their rows, the turns they begin and end with, and `at`, their place.
    """
    keyed = rows.withColumn("_tie", F.substring("text", 1, 64))  # in the order of the texts, and short enough for a sample of range ends
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("_tie").asc()]
    dealt = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order, "text").drop("_tie")
    kind = rows.schema["conv"].dataType.simpleString()
    schema = StructType.fromDDL(f"conv {kind}, whole boolean, at long, nth long, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, sha string, roles array<string>, texts array<string>")

    def cut(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)
        place = TaskContext.get().partitionId() << 32
        held, out = [], []
        size = nth = 0  # bytes held; parts of this conversation so far
        first = True  # the conversation may have begun in an earlier partition

        def part():
            nonlocal size, nth, held
            turns = [t for _, t, _, _ in held if t is not None]
            distinct = len(set(turns))
            out.append({"conv": held[0][0], "whole": False, "at": place + len_out[0], "nth": nth, "low": min(turns, default=None), "high": max(turns, default=None), "turns": distinct, "roles": [r for *_, r, _ in held], "texts": [t for *_, t in held]})
            len_out[0] += 1
            nth += 1
            held, size = [], 0

        def whole():
            nonlocal size, held
            texts = [(r, t) for *_, r, t in held]
            turns = [t for _, t, _, _ in held if t is not None]
            faults = tagged(texts, set())
            initials = "".join(r[:1] or "?" for r, _ in texts)
            cost, audit = cheapest(initials, faults)
            told = "\n".join(f"{r}:{t}" for r, t in repaired(NOTHING, audit, texts))
            out.append({
                "conv": held[0][0], "whole": True, "low": min(turns, default=None), "high": max(turns, default=None), "turns": len(set(turns)),
                "blank": faults.count("1"), "duplicate": faults.count("2"), "truncated": faults.count("3"), "illegal": illegal_pairs(initials),
                "cost": cost, "audit": audit, "sha": hashlib.sha256(told.encode("utf-8", "replace")).hexdigest(),
            })
            held, size = [], 0

        def handed():
            nonlocal out
            made = pa.RecordBatch.from_pylist(out, schema=kinds)
            out = []
            return made

        len_out = [0]
        weight = 0
        for batch in batches:
            for conv, turn, role, text in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                if held and held[0][0] != conv:
                    if first or nth:
                        part()
                    else:
                        whole()
                    first, nth = False, 0
                elif len(held) >= most or size >= BYTES:
                    part()
                held.append((conv, turn, role, text))
                size += len(text) + len(role)
                weight += len(text) + len(role) + 64
                if weight > BYTES and out:
                    yield handed()
                    weight = 0
        if held:
            part()
        if out:
            yield handed()

    return store(dealt.select("conv", "turn", "role", "text").mapInArrow(cut, schema), "conversations")


def _of_parts(parts: DataFrame, fan: int) -> DataFrame:
    """The results of conversations that came in parts: `conv` and the columns that _parts() gives for whole ones.

    Repeats across parts are found by their hashes; each part is reduced to the least costs and edits between its states; parts are combined `fan` at a time, until
    each conversation is one, and the states chosen there are handed back down. Then each part knows its edits. Only the last step, a SHA-256 over one text and the
    audit as one string, is in the order of the conversation by nature: it reads a row a part, with the hash as its only state.
    """
    kind = parts.schema["conv"].dataType.simpleString()
    parts = parts.withColumn("_c", F.xxhash64(F.col("conv").isNull(), "conv"))
    told = F.posexplode(F.arrays_zip("roles", "texts"))
    prints = parts.select("conv", "at", told.alias("i", "x")).select("conv", "at", "i", F.xxhash64("conv", "x.roles", "x.texts").alias("h1"), F.xxhash64(F.lit(1), "x.texts", "x.roles", "conv").alias("h2"))
    firsts = prints.groupBy("h1", "h2").agg(F.min("at").alias("first"))
    later = skew_join(prints, firsts, ["h1", "h2"]).where("at > first").groupBy("at").agg(F.collect_list("i").alias("seen"))  # the rows of a part at the most
    given = parts.join(later, "at", "left").select("conv", "at", "_c", "roles", "texts", "seen")

    def reduce_part(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)
        for batch in batches:
            for conv, at, c, roles, texts, again in zip(*[batch.column(i).to_pylist() for i in range(6)], strict=True):
                rows, earlier = list(zip(roles, texts, strict=True)), set(again or ())
                faults = tagged(rows, {rows[i] for i in earlier})
                initials = "".join(r[:1] or "?" for r in roles)
                found = edits_between(initials, faults)
                out = {
                    "conv": conv, "at": at, "c": c, "faults": faults, "initials": initials,
                    "pairs": [{"s": s, "t": t, "cost": cost, "edits": e} for (s, t), (cost, e) in found.items()],
                }
                yield pa.RecordBatch.from_pylist([out], schema=kinds)

    schema = StructType.fromDDL(f"conv {kind}, at long, c long, faults string, initials string, pairs array<struct<s int, t int, cost long, edits string>>")
    reduced = store(given.mapInArrow(reduce_part, schema), "reduced")
    numbered = store(_numbered(reduced.select("c", "at")), "numbered")
    level = reduced.join(numbered, ["c", "at"]).select("c", F.col("n").alias("k"), F.transform("pairs", lambda p: F.struct(p["s"].alias("s"), p["t"].alias("t"), p["cost"].alias("cost"), p["edits"].alias("rank"))).alias("pairs"))

    def combine(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(above)
        for batch in batches:
            for c, k, group in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                pairs, paths = joined([{(p["s"], p["t"]): (p["cost"], p["rank"]) for p in x["pairs"]} for x in group])
                found = [{"s": s, "t": t, "cost": cost, "rank": f"{rank:02d}", "path": list(paths[s, t])} for (s, t), (cost, rank) in pairs.items()]
                yield pa.RecordBatch.from_pylist([{"c": c, "k": k, "pairs": found}], schema=kinds)

    above = StructType.fromDDL("c long, k long, pairs array<struct<s int, t int, cost long, rank string, path array<int>>>")
    ups = []
    while True:
        group = F.floor(F.col("k") / fan).cast("long").alias("g")
        groups = level.groupBy("c", group).agg(F.sort_array(F.collect_list(F.struct("k", "pairs"))).alias("group"))  # `fan` at the most
        ups.append(store(groups.mapInArrow(combine, above), f"level{len(ups)}"))
        if not ups[-1].where("k > 0").limit(1).count():
            break
        level = ups[-1].select("c", "k", F.transform("pairs", lambda p: F.struct(p["s"].alias("s"), p["t"].alias("t"), p["cost"].alias("cost"), p["rank"].alias("rank"))).alias("pairs"))

    def choose(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for c, pairs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                cost, _, end = best_end({(p["s"], p["t"]): (p["cost"], p["rank"]) for p in pairs})
                rows.append((c, 0, NOTHING, end, cost))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["c", "k", "s", "t", "cost"])

    top = store(ups[-1].select("c", "pairs").mapInArrow(choose, "c long, k long, s int, t int, cost long"), "chosen")
    costs = top.select("c", "cost", "t")
    chosen = top.select("c", "k", "s", "t")
    for up in reversed(ups):
        paths = up.select("c", "k", F.explode("pairs").alias("p")).select("c", "k", F.col("p.s").alias("s"), F.col("p.t").alias("t"), F.col("p.path").alias("path"))
        picked = paths.join(chosen, ["c", "k", "s", "t"])
        steps = F.transform(F.sequence(F.lit(0), F.size("path") - 2), lambda i: F.struct((F.col("k") * fan + i).alias("k"), F.get("path", i).alias("s"), F.get("path", i + 1).alias("t")))
        chosen = picked.select("c", F.explode(steps).alias("x")).select("c", "x.k", "x.s", "x.t")
    edits = numbered.join(chosen.withColumnRenamed("k", "n"), ["c", "n"]).join(reduced, ["c", "at"])
    pick = F.filter("pairs", lambda p: (p["s"] == F.col("s")) & (p["t"] == F.col("t")))[0]["edits"]
    done = store(edits.select("c", "at", "s", pick.alias("edits"), "faults", "initials"), "edits")
    last = costs.select("c", F.col("t").alias("end"), "cost")
    final = parts.select("conv", F.col("_c").alias("c"), "at", "low", "high", "turns", "roles", "texts").join(done, ["c", "at"]).join(last, "c")
    many = max(int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    columns = ["conv", "c", "at", "low", "high", "turns", "roles", "texts", "s", "edits", "faults", "initials", "end", "cost"]
    out = StructType.fromDDL(f"conv {kind}, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, sha string")

    def finish(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(out)
        state = None

        def ended():
            tail = [f"{r}:{t}" for r, t in repaired(state["end"], CLOSING[state["end"]], ())]
            if tail:
                state["hash"].update(("\n" * state["any"] + "\n".join(tail)).encode())
            row = {k: state[k] for k in ("conv", "low", "high", "turns", "blank", "duplicate", "truncated", "illegal", "cost")}
            return pa.RecordBatch.from_pylist([row | {"audit": "".join(state["edits"]) + CLOSING[state["end"]], "sha": state["hash"].hexdigest()}], schema=kinds)

        for batch in batches:
            for i in range(batch.num_rows):
                x = {n: batch.column(j)[i].as_py() for j, n in enumerate(columns)}
                if state and state["c"] != x["c"]:
                    yield ended()
                    state = None
                if state is None:
                    state = {"c": x["c"], "conv": x["conv"], "low": None, "high": None, "turns": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": x["cost"], "end": x["end"], "edits": [], "hash": hashlib.sha256(), "any": False, "last": ""}
                if x["low"] is not None:
                    # Turns rise from part to part, so a turn that two parts share is the last of one and the first of the other.
                    state["turns"] += x["turns"] - (state["high"] == x["low"])
                    state["low"] = x["low"] if state["low"] is None else state["low"]
                    state["high"] = x["high"]
                for name, digit in (("blank", "1"), ("duplicate", "2"), ("truncated", "3")):
                    state[name] += x["faults"].count(digit)
                state["illegal"] += illegal_pairs(state["last"] + x["initials"])
                state["last"] = x["initials"][-1:]
                state["edits"].append(x["edits"])
                for r, t in repaired(x["s"], x["edits"], zip(x["roles"], x["texts"], strict=True)):
                    state["hash"].update(("\n" * state["any"] + f"{r}:{t}").encode("utf-8", "replace"))
                    state["any"] = True
        if state:
            yield ended()

    return final.select(*columns).repartition(many, "c").sortWithinPartitions("c", "at").mapInArrow(finish, out)


def _numbered(parts: DataFrame) -> DataFrame:
    """`n`: the number of each part within its conversation, from 0. Parts are few (ROWS rows each), and only their places are sorted."""
    from pyspark.sql import Window

    return parts.select("c", "at", (F.row_number().over(Window.partitionBy("c").orderBy("at")) - 1).cast("long").alias("n"))


def repair(rows: DataFrame, conversations: DataFrame | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", most: int = ROWS, fan: int = FAN) -> DataFrame:
    """One row for each conversation of `rows`: `conv`, `gaps`, `blank`, `duplicate`, `truncated`, `illegal`, `cost` long, `audit`, `repaired_sha256` string.

    Rows go by turn (nulls first), those of one turn by role and text. A null role or text is one space; rows with a null conversation id are one conversation. The
    first fault of a row counts: blank (nothing but white space), duplicate (role and text seen earlier in the conversation), truncated (its last character that isn't white space
    isn't one of .!?). Edits: Keep (0), Retitle to user or assistant (2), Delete (3; needed for blank and duplicate rows), Insert an empty turn of user or assistant (2); truncated rows that stay add 1.
    `audit` has the initials K, R, D, I of the cheapest edits after which role initials read (s?(ua)+)?; ties: the least in ASCII order. `repaired_sha256`
    is of the repaired `role:text` lines. gaps: turns missing between the least and the greatest (null turns aside; 0 if all are null). illegal: neighbours whose initials aren't su, ua or au.

    `conversations`: a table whose distinct `conv` are all returned (default: those of `rows`); one without rows has zeros, an empty audit and the hash of the empty string.
    Other columns are dropped. No rows: no rows.
    """
    names = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"))
    found = _parts(names, most)
    columns = ["conv", "low", "high", "turns", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "sha"]
    done = found.where("whole").select(*columns).unionByName(_of_parts(found.where("NOT whole"), fan).select(*columns))
    every = (rows if conversations is None else conversations).select(F.col(conv).alias("_conv")).distinct()
    done = every.join(done, F.col("_conv").eqNullSafe(F.col("conv")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return done.select(
        F.col("_conv").alias(conv), F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).cast("long").alias("gaps"),
        *[zero(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
