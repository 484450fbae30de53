"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant turns in alternation, ending with the
assistant. Each turn of a conversation may be kept, relabelled, merged into the turn before it, or preceded by empty
turns; dynamic programming over the automaton of legal turns finds the cheapest repair, ties going to the first action in
the order of ACTIONS and then to the earlier state. The repaired conversation is rendered as segments, one for each
turn of the input and one that closes; concatenated in order of pos they are the formatted conversation.

Scale: conversations of any length are cut into blocks of at most BLOCK turns and BLOCK_BYTES of text. A block is summed up as a matrix of least
costs between the automaton's states; matrices of a conversation's blocks are chained, which takes a row for each block;
then every block is solved between its known end states. No task holds a conversation.

Defined results: a null or unknown role is relabelled at a small cost; null text is empty; turns are ordered by turn (null
last), role and text; rows with a null conv_id are one conversation; repeated turns are turns of their own and get
merged; the template's marks inside texts are broken by a space; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import stored

BLOCK = 4096  # most turns of a block
BLOCK_BYTES = 8 << 20  # of text, of which a block holds no more, unless a turn alone does

STATES = ("start", "system", "user", "assistant")
ROLES = {"system": "system", "developer": "system", "user": "user", "human": "user", "prompter": "user", "assistant": "assistant", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
NEXT = {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}

#: Costs of the repairs. Relabelling a system turn, or into one, loses more than swapping the two speakers.
MERGE, INSERT, RELABEL, RELABEL_SYSTEM, LABEL_UNKNOWN = 3, 10, 6, 9, 1
ACTIONS = ("keep", "merge", "relabel", "insert")
FAR = 1 << 40  # no way


def _relabel_cost(role: str | None, to: str) -> int:
    if role == to:
        return 0
    if role is None:
        return LABEL_UNKNOWN + (2 if to == "system" else 0)
    return RELABEL_SYSTEM if "system" in (role, to) else RELABEL


def _fill(state: str, to: str) -> list[str] | None:
    """The shortest run of empty turns after which `to` may follow `state`; null if there is none of at most two."""
    if to in NEXT[state]:
        return []
    for a in ("user", "assistant"):
        if a in NEXT[state]:
            if to in NEXT[a]:
                return [a]
            for b in NEXT[a]:
                if to in NEXT[b]:
                    return [a, b]
    return None


def _step(role: str | None) -> tuple[np.ndarray, dict]:
    """Least costs from state to state by one turn of this role, and the action of each: (name, empty turns before it)."""
    cost, action = np.full((4, 4), FAR, np.int64), {}
    for s, state in enumerate(STATES):
        for t, to in enumerate(STATES):
            ways = []
            if to == state and state != "start":
                ways.append((MERGE + _relabel_cost(role, to), ACTIONS.index("merge"), []))
            if to != "start" and (fill := _fill(state, to)) is not None:
                name = "insert" if fill else "keep" if role == to else "relabel"
                ways.append((INSERT * len(fill) + _relabel_cost(role, to), ACTIONS.index(name), fill))
            if ways:
                best = min(ways, key=lambda w: w[:2])
                cost[s, t], action[s, t] = best[0], (ACTIONS[best[1]], best[2])
    return cost, action


_STEPS = {role: _step(role) for role in ("system", "user", "assistant", None)}
#: What it takes to end in each state: the empty turns that make the conversation legal.
_ENDINGS = {"start": [], "system": ["user", "assistant"], "user": ["assistant"], "assistant": []}
_END_COST = np.array([INSERT * len(_ENDINGS[s]) for s in STATES], np.int64)
_IDENTITY = np.where(np.eye(4, dtype=bool), 0, FAR)


def _known(role) -> str | None:
    return ROLES.get(str(role).strip().lower()) if isinstance(role, str) else None


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least costs of one way after another."""
    return np.minimum((a[:, :, None] + b[None]).min(axis=1), FAR)


def _best_path(matrices: list[np.ndarray], start: int, end: int | None) -> list[int]:
    """States before and after each matrix on the cheapest way from start to end; to the cheapest legal ending, if end is None."""
    cost = np.full(4, FAR, np.int64)
    cost[start] = 0
    back = []
    for m in matrices:
        ways = cost[:, None] + m
        back.append(ways.argmin(axis=0))
        cost = np.minimum(ways.min(axis=0), FAR)
    state = int((cost + _END_COST).argmin()) if end is None else end
    path = [state]
    for b in reversed(back):
        state = int(b[state])
        path.append(state)
    return path[::-1]


# --- blocks -------------------------------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, chunk long, block long, k int, product array<long>"
STARTS = "chunk long, block long, start int, stop int, offset long, ends boolean"
SEGMENTS = "conv_id long, pos long, turn long, role string, new_role string, action string, rendered string"


def _cut(most: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Numbers chunks of `most` rows, blocks (the runs of a conversation within a chunk) and rows; the last row of a block
        holds the block's matrix."""
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        seen, held = 0, None

        def finish(own: pd.DataFrame, chunk: int) -> pd.DataFrame:
            conv = own["conv_id"]
            new = ((conv != conv.shift()) & ~(conv.isna() & conv.shift().isna())).to_numpy()
            new[0] = True
            block = np.cumsum(new) - 1
            first = np.flatnonzero(new)
            own = own.assign(chunk=chunk, block=block, k=np.arange(len(own)) - first[block])
            products: list = [None] * len(own)
            roles = [_known(r) for r in own["role"]]
            for a, b in zip(first, [*first[1:], len(own)], strict=True):
                m = _IDENTITY
                for r in roles[a:b]:
                    m = _times(m, _STEPS[r][0])
                products[b - 1] = m.ravel().tolist()
            return own.assign(product=products)

        def fits(rows: pd.DataFrame) -> int:
            """How many of the rows fill a chunk; 0 if all of them do not."""
            upto = np.cumsum([len(t) if isinstance(t, str) else 0 for t in rows["text"]])
            n = max(1, int(np.searchsorted(upto, BLOCK_BYTES, side="right")))
            return min(n, most) if n < len(rows) or len(rows) >= most else 0

        for pdf in batches:
            held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            while len(held) and (n := fits(held)):
                yield finish(held.iloc[:n].reset_index(drop=True), base + seen)
                held, seen = held.iloc[n:].reset_index(drop=True), seen + 1
        if held is not None and len(held):
            yield finish(held, base + seen)

    return run


def _chain(pdf: pd.DataFrame) -> pd.DataFrame:
    """End states and offsets of the blocks of one conversation that has several."""
    pdf = pdf.sort_values(["chunk", "block"])
    path = _best_path([np.array(p, np.int64).reshape(4, 4) for p in pdf["product"]], 0, None)
    sizes = pdf["k"].to_numpy() + 1
    return pd.DataFrame({"chunk": pdf["chunk"], "block": pdf["block"], "start": path[:-1], "stop": path[1:], "offset": np.cumsum(sizes) - sizes, "ends": [False] * (len(pdf) - 1) + [True]})


def _turn(role: str, text: str = "") -> str:
    return f"<|{role}|>\n{text}"


_CLOSE = "<|end|>\n"


def _segments(rows: pd.DataFrame, starts: pd.DataFrame) -> pd.DataFrame:
    """The repaired turns of a chunk's blocks. A block without a row in starts is a whole conversation."""
    known = {r.block: r for r in starts.itertuples()}
    out = []
    for block, own in rows.sort_values(["block", "k"]).groupby("block", sort=True):
        at = known.get(block)
        roles = [_known(r) for r in own["role"]]
        path = _best_path([_STEPS[r][0] for r in roles], at.start if at else 0, at.stop if at else None)
        offset = int(at.offset) if at else 0
        for k, r in enumerate(own.itertuples()):
            state, to = STATES[path[k]], STATES[path[k + 1]]
            name, fill = _STEPS[roles[k]][1][path[k], path[k + 1]]
            text = (r.text if isinstance(r.text, str) else "").replace("<|", "< |")
            if name == "merge":
                piece = "\n" + text
            else:
                piece = (_CLOSE if state != "start" else "") + "".join(_turn(f) + _CLOSE for f in fill) + _turn(to, text)
            out.append((r.conv_id, offset + k, r.turn, r.role, to, name, piece))
        if at is None or at.ends:
            fill = _ENDINGS[STATES[path[-1]]]
            piece = _CLOSE + "".join(_turn(f) + _CLOSE for f in fill)
            out.append((own["conv_id"].iloc[0], offset + len(own), None, None, fill[-1] if fill else STATES[path[-1]], "insert" if fill else "close", piece))
    found = pd.DataFrame(out, columns=["conv_id", "pos", "turn", "role", "new_role", "action", "rendered"])
    return found.astype({"conv_id": "Int64", "turn": "Int64"})


def repair(turns: DataFrame, most: int = BLOCK) -> DataFrame:
    """conv_id, pos, turn, role, new_role, action, rendered: the segments of every conversation."""
    rows = turns.select(*[F.col(c).cast(t).alias(c) for c, t in (("conv_id", "long"), ("turn", "long"), ("role", "string"), ("text", "string"))])
    order: list[Column] = [F.col("conv_id"), F.col("turn").asc_nulls_last(), F.col("role"), F.col("text")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    cut = stored(ordered.mapInPandas(_cut(most), TURNS), "chat-turns")
    ends = cut.where(F.col("product").isNotNull()).select("conv_id", "chunk", "block", "k", "product")
    several = stored(ends.groupBy("conv_id").count().where("count > 1"), "chat-long")
    parts = ends.join(several, ends["conv_id"].eqNullSafe(several["conv_id"]), "left_semi")
    starts = parts.groupBy("conv_id").applyInPandas(_chain, STARTS)
    return cut.drop("product").groupBy("chunk").cogroup(starts.groupBy("chunk")).applyInPandas(_segments, SEGMENTS)


def op7_chat(conversations: DataFrame) -> DataFrame:
    return repair(conversations)
