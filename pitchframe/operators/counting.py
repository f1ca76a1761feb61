"""What each ball's keys have counted before it, in one pass over balls sorted by innings or another group; runs inside tasks on Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from ..functions.expr import COUNTS
from .state import INNINGS

FORGET = 1_000_000  #: codes after which a task begins anew with the next group


class Codes:
    """Numbers of values and of pairs of numbers, the same for equal ones as long as they are held."""

    def __init__(self) -> None:
        self.values: dict = {}
        self.pairs: dict = {}

    def __len__(self) -> int:
        return len(self.values) + len(self.pairs)

    def _of(self, held: dict, keys: list):
        import numpy as np

        return np.fromiter((held.setdefault(k, len(self)) for k in keys), np.int64, len(keys))

    def column(self, values):
        """The numbers of an Arrow column's values, -1 for null."""
        import numpy as np

        found = values.dictionary_encode()
        at = found.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        return np.append(self._of(self.values, found.dictionary.to_pylist()), -1)[at]  # the last one for null

    def both(self, a, b):
        """The numbers of pairs, -1 where either has none."""
        import numpy as np

        known = (a >= 0) & (b >= 0)
        pairs, at = np.unique((a << 31 | b)[known], return_inverse=True)
        out = np.full(len(a), -1, np.int64)
        out[known] = self._of(self.pairs, pairs.tolist())[at]
        return out


def before(ids, asks, weights, held):
    """(what each of ``asks`` found before it, the new totals): ``ids`` count ``weights`` one after the other, each after the ask at its place.

    Negative ids count nothing and find nothing. ``held``: sorted ids and their totals so far, which are changed.
    """
    import numpy as np

    n, same = len(ids), asks is ids
    events = ids if same else np.stack([asks, ids], axis=1).ravel()  # an ask, then what is counted at its place
    added = weights
    if not same:
        added = np.zeros((2 * n, weights.shape[1]), np.int64)
        added[1::2] = weights
    order = np.argsort(events, kind="stable")
    order = order[np.searchsorted(events[order], 0) :]
    ordered, added = events[order], added[order]
    upto = np.cumsum(added, axis=0)
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])[: len(ordered)])
    sizes = np.diff(np.append(first, len(ordered)))
    keys = ordered[first]
    known, totals = held
    at = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
    start = np.where((known[at] == keys)[:, None], totals[at], 0) if len(known) else np.zeros((len(keys), weights.shape[1]), np.int64)
    offset = start - (upto - added)[first]
    found = np.zeros((len(events), weights.shape[1]), np.int64)
    found[order] = upto - added + np.repeat(offset, sizes, axis=0)
    after = upto[first + sizes - 1] + offset if len(first) else start
    if len(known):
        there = known[at] == keys
        totals[at[there]] = after[there]  # new keys go where they keep the order
        keys, after, at = keys[~there], after[~there], np.searchsorted(known, keys[~there])
        return found if same else found[::2], (np.insert(known, at, keys), np.insert(totals, at, after, axis=0))
    return found if same else found[::2], (keys, after)


def counted(
    kinds: dict[str, tuple[tuple[str, ...], tuple[str, ...]]], columns: list[str], group: tuple[str, ...] = INNINGS, sums: dict[str, dict[str, str]] | None = None
) -> Callable[[Iterator], Iterator]:
    """For ``mapInArrow``: balls (``columns``, and a null _context) with the counts before them of each of ``kinds``: the keys that a ball
    counts under, and those that it asks for. Rows come by ``group``, in order; those with a _context only count, for it or for all (``*``).
    ``sums``: by a key of balls, names of sums over the key's earlier balls of the group, and what they add up; a null key is one of its own."""
    sums = sums or {}

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute  # noqa: F401  fill_null is there only then

        nothing = np.zeros(0, np.int64), np.zeros((0, len(COUNTS)), np.int64)
        empty = dict.fromkeys(kinds, nothing) | {(key,): (nothing[0], np.zeros((0, len(of)), np.int64)) for key, of in sums.items()}
        codes, held, last, number = Codes(), dict(empty), None, 0

        def places(batch):
            """The running number of each row's group; the same in the next batch for a group that goes on."""
            nonlocal last, number
            fields = [batch.column(c) for c in group]
            new = np.zeros(batch.num_rows, bool)
            for f in fields:
                values = codes.column(f)
                new[1:] |= values[1:] != values[:-1]
            head = tuple(f[0].as_py() for f in fields)
            new[0] = last is not None and head != last
            out = number + np.cumsum(new)
            last, number = tuple(f[-1].as_py() for f in fields), int(out[-1])
            return out

        def passed(batch, place):
            context = batch.column("_context")
            ball = context.is_null().to_numpy(zero_copy_only=False)
            weights = np.stack([batch.column(c).to_numpy() for c in COUNTS], axis=1).astype(np.int64)
            of, made = codes.column(context), {}

            def key(names: tuple[str, ...]):
                if names not in made:
                    if len(names) > 1:
                        made[names] = codes.both(key(names[:-1]), key(names[-1:]))
                    else:
                        made[names] = codes.column(batch.column(names[0])) if names else np.zeros(batch.num_rows, np.int64)
                return made[names]

            out = [batch.column(c).filter(context.is_null()) for c in columns]
            for name, (counts, asks) in kinds.items():
                mine = ball | (of == codes.values.get(name, -2)) | (of == codes.values.get("*", -2))
                ids, wanted = (np.where(k >= 0, place << 32 | k, -1)[mine] for k in (key(counts), key(asks)))
                found, (keys, totals) = before(ids, ids if counts == asks else np.where(ball[mine], wanted, -1), weights[mine], held[name])
                stay = np.searchsorted(keys, place[-1] << 32)  # the last group's keys are behind all others
                held[name] = keys[stay:], totals[stay:]
                found = found[ball[mine]]
                out += [pa.array(found[:, i]) for i in range(len(COUNTS))]
            for name, of in sums.items():
                ids = (place << 32 | codes.column(batch.column(name)) + 1)[ball]
                added = np.stack([batch.column(c).fill_null(0).to_numpy() for c in of.values()], axis=1).astype(np.int64)
                found, (keys, totals) = before(ids, ids, added[ball], held[name,])
                stay = np.searchsorted(keys, place[-1] << 32)
                held[name,] = keys[stay:], totals[stay:]
                out += [pa.array(found[:, i]) for i in range(len(of))]
            return pa.RecordBatch.from_arrays(out, [*columns, *(f"{c}_{n}" for c in kinds for n in COUNTS), *(s for of in sums.values() for s in of)])

        for batch in batches:
            if not batch.num_rows:
                continue
            place = places(batch)
            cut = int(np.searchsorted(place, place[-1])) if len(codes) > FORGET else 0
            if cut:
                yield passed(batch.slice(0, cut), place[:cut])
            if len(codes) > FORGET and (cut or not any((k >> 32 == place[-1]).any() for k, _ in held.values())):
                codes, held = Codes(), dict(empty)
            yield passed(batch.slice(cut), place[cut:])

    return run
