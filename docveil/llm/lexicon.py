"""A minimal acyclic transducer from words to tokenizer ids, kept as flat memory-mapped arrays.

Words are added in order and equal right languages are merged as they are closed
(incremental minimization of a sorted list), so prefixes and suffixes are shared. Each
transition carries the number of words that sort before those behind it; the sum along a
path is the word's number, whose ids stand in one flat array. Lookup walks all given
words at once, one symbol a step, with array gathers.
"""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pyarrow as pa

FIELDS = ("symbols", "moves", "target", "skip", "final", "id_offsets", "ids")


def minimal(words: list[str]) -> tuple[list[dict[str, int]], list[bool]]:
    """Transitions and final marks of the minimal automaton of sorted distinct words; state 0 is the start."""
    moves: list[dict[str, int]] = [{}]
    final = [False]
    register: dict[tuple, int] = {}
    free: list[int] = []
    path: list[tuple[int, str, int]] = []

    def close(depth: int) -> None:
        while len(path) > depth:
            above, symbol, state = path.pop()
            signature = (final[state], *moves[state].items())
            known = register.get(signature)
            if known is None:
                register[signature] = state
            else:
                moves[above][symbol] = known
                moves[state] = {}
                free.append(state)

    before = ""
    for word in words:
        shared = 0
        limit = min(len(word), len(before))
        while shared < limit and word[shared] == before[shared]:
            shared += 1
        close(shared)
        state = path[-1][2] if path else 0
        for symbol in word[shared:]:
            if free:
                new = free.pop()
                final[new] = False
            else:
                new = len(moves)
                moves.append({})
                final.append(False)
            moves[state][symbol] = new
            path.append((state, symbol, new))
            state = new
        final[state] = True
        before = word
    close(0)
    return moves, final


class Lexicon:
    """Arrays of the transducer. `number(cp, start, length)` gives each word's number, -1 for words that are not in it."""

    def __init__(self, **arrays: np.ndarray):
        for name in FIELDS:
            setattr(self, name, arrays[name])
        self.width = len(self.symbols) + 1
        self.code = np.zeros(0x110001, np.int32)
        self.code[self.symbols] = np.arange(1, self.width)

    @classmethod
    def of(cls, entries: dict[str, list[int]]) -> "Lexicon":
        words = sorted(w for w in entries if w)
        moves, final = minimal(words)
        order, seen = [0], {0}
        for state in order:  # breadth first; the list grows as it is read
            for nxt in moves[state].values():
                if nxt not in seen:
                    seen.add(nxt)
                    order.append(nxt)
        below: dict[int, int] = {}

        def count(state: int) -> int:
            todo = [state]
            while todo:
                x = todo[-1]
                open_ = [y for y in moves[x].values() if y not in below]
                if open_:
                    todo.extend(open_)
                else:
                    below[x] = final[x] + sum(below[y] for y in moves[x].values())
                    todo.pop()
            return below[state]

        count(0)
        name = {state: i for i, state in enumerate(order)}
        symbols = sorted({s for state in order for s in moves[state]})
        code = {s: i + 1 for i, s in enumerate(symbols)}
        width = len(symbols) + 1
        key, target, skip = [], [], []
        for state in order:
            passed = int(final[state])
            for s in sorted(moves[state]):
                key.append(name[state] * width + code[s])
                target.append(name[moves[state][s]])
                skip.append(passed)
                passed += below[moves[state][s]]
        lens = [len(entries[w]) for w in words]
        return cls(
            symbols=np.array([ord(s) for s in symbols], np.int64), moves=np.array(key, np.int64), target=np.array(target, np.int32), skip=np.array(skip, np.int32),
            final=np.array([final[s] for s in order], bool).astype(np.int8), id_offsets=np.concatenate([[0], np.cumsum(lens)]).astype(np.int64), ids=np.array([i for w in words for i in entries[w]], np.int32),
        )

    def number(self, cp: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        out = np.zeros(len(start), np.int64)
        state = np.zeros(len(start), np.int64)
        if not len(self.moves):
            return out - 1
        live = np.argsort(-length, kind="stable")
        sizes = length[live]
        step = 0
        while len(live):
            n = int(np.searchsorted(-sizes, -step, "left"))  # words longer than step
            live, sizes = live[:n], sizes[:n]
            if not n:
                break
            key = state[live] * self.width + self.code[cp[start[live] + step]]
            at = np.searchsorted(self.moves, key)
            at[at == len(self.moves)] = 0
            found = self.moves[at] == key
            out[live[~found]] = -1
            live, sizes, at = live[found], sizes[found], at[found]
            state[live] = self.target[at]
            out[live] += self.skip[at]
            step += 1
        ok = out >= 0
        out[ok & (self.final[state] == 0)] = -1
        return out

    def save(self, folder: str) -> str:
        """Writes the arrays as one Arrow file named by its content; gives its path."""
        columns = [pa.array([getattr(self, f)], pa.large_list(pa.from_numpy_dtype(getattr(self, f).dtype))) for f in FIELDS]
        batch = pa.RecordBatch.from_arrays(columns, names=list(FIELDS))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_file(sink, batch.schema) as w:
            w.write_batch(batch)
        data = sink.getvalue().to_pybytes()
        path = os.path.join(folder, f"lexicon-{hashlib.sha256(data).hexdigest()[:20]}.arrow")
        if not os.path.exists(path):
            os.makedirs(folder, exist_ok=True)
            part = f"{path}.{os.getpid()}"
            with open(part, "wb") as f:
                f.write(data)
            os.replace(part, path)
        return path

    @classmethod
    def load(cls, path: str) -> "Lexicon":
        batch = pa.ipc.open_file(pa.memory_map(path)).get_batch(0)
        return cls(**{f: batch.column(f).values.to_numpy() for f in FIELDS})
