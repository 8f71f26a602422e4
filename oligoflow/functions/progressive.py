"""Progressive alignment of some hundred sequences or profiles: guide tree, profile-to-profile dynamic programming, refinement.

Everything maximises the sum-of-pairs score: MATCH or MISMATCH for two residues, GAP for a residue and a gap, 0 for two gaps, over
all pairs of rows and all columns.  A profile holds, for each column, how many of its rows have which symbol, so aligning two
profiles maximises that score over all pairs between them exactly.  A profile has at least one column.
"""

from __future__ import annotations

import numpy as np

MATCH, MISMATCH, GAP = 2.0, -1.0, -2.0
#: Length of the words that tell how near two inputs are, and places their counts are hashed to.
WORD, PLACES = 4, 512


def score_matrix(symbols: int) -> np.ndarray:
    """Scores of pairs of so many symbols, the last of which is the gap."""
    out = np.full((symbols, symbols), MISMATCH)
    np.fill_diagonal(out, MATCH)
    out[-1, :], out[:, -1] = GAP, GAP
    out[-1, -1] = 0.0
    return out


def one_hot(codes: np.ndarray, symbols: int) -> np.ndarray:
    """Profile (columns, symbols) of a single sequence of symbol numbers."""
    out = np.zeros((len(codes), symbols))
    out[np.arange(len(codes)), codes] = 1.0
    return out


def path(p: np.ndarray, q: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Columns of the merged alignment that the columns of two profiles take, and the score over all pairs between them.

    Of equally good ways, from the end, columns are matched before those of ``p`` stand alone before those of ``q``.
    """
    n, m = len(p), len(q)
    rows_p, rows_q = (x.sum(axis=1).max(initial=0) for x in (p, q))
    match = p @ score @ q.T
    alone_p, alone_q = (p @ score[:, -1]) * rows_q, (q @ score[:, -1]) * rows_p
    steps = np.concatenate([[0.0], np.cumsum(alone_q)])
    row, way = steps.copy(), np.zeros((n + 1, m + 1), np.uint8)  # 0: matched, 1: p alone, 2: q alone
    way[0, :] = 2
    for i in range(n):
        up = row + alone_p[i]
        best = up.copy()
        diagonal = row[:-1] + match[i]
        matched = diagonal >= up[1:]
        best[1:] = np.where(matched, diagonal, up[1:])
        new = np.maximum.accumulate(best - steps) + steps
        way[i + 1] = 1
        way[i + 1, 1:][matched] = 0
        way[i + 1][new > best + 1e-9 * np.maximum(1.0, np.abs(best))] = 2
        row = new
    at_p, at_q, i, j, k = np.empty(n, np.int64), np.empty(m, np.int64), n, m, 0
    while i or j:
        w = way[i, j]
        k -= 1
        if w != 2:
            i -= 1
            at_p[i] = k
        if w != 1:
            j -= 1
            at_q[j] = k
    return at_p - k, at_q - k, float(row[-1])


def _placed(block: np.ndarray, at: np.ndarray, columns: int) -> np.ndarray:
    """Aligned inputs (inputs, columns, symbols) spread to more columns; new ones are gaps in all their rows."""
    out = np.zeros((len(block), columns, block.shape[2]))
    out[:, :, -1] = block.sum(axis=2).max(axis=1, initial=0)[:, None]
    out[:, at] = block
    return out


def _joined(a: np.ndarray, b: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, float]:
    """Two blocks of aligned inputs as one, and the score between them."""
    at_a, at_b, total = path(a.sum(axis=0), b.sum(axis=0), score)
    columns = int(max(at_a.max(initial=-1), at_b.max(initial=-1))) + 1
    return np.concatenate([_placed(a, at_a, columns), _placed(b, at_b, columns)]), total


def _dense(block: np.ndarray) -> np.ndarray:
    """Without columns that hold gaps only."""
    return block[:, block[:, :, :-1].any(axis=(0, 2))]


def distances(profiles: list[np.ndarray]) -> np.ndarray:
    """Share of words that two inputs (their commonest residues) don't have in common."""
    counts = np.zeros((len(profiles), PLACES))
    for k, p in enumerate(profiles):
        code = p[:, :-1].argmax(axis=1) + 1
        n = max(len(code) - WORD + 1, 1)
        h = sum(np.pad(code, (0, WORD))[s : s + n] * 31**s for s in range(WORD)) % PLACES
        counts[k] = np.bincount(h, minlength=PLACES)
    total = counts.sum(axis=1)
    common = np.stack([np.minimum(c, counts).sum(axis=1) for c in counts])
    return 1.0 - common / np.maximum(np.minimum(total[:, None], total[None, :]), 1)


def guide_tree(distance: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int]]:
    """Merges of average linkage, nearest first; the k-th makes node n + k.  Ties take the first nodes."""
    n = len(distance)
    d, size, name = distance.copy(), sizes.astype(float).copy(), list(range(n))
    np.fill_diagonal(d, np.inf)
    out = []
    for k in range(n - 1):
        i, j = sorted(divmod(int(d.argmin()), n))
        out.append((name[i], name[j]))
        mean = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i], d[:, i] = mean, mean
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        name[i] = n + k
    return out


def align(profiles: list[np.ndarray], passes: int = 2) -> list[np.ndarray]:
    """For each profile (columns, symbols), the columns of the common alignment that its columns take.

    Built along a guide tree; then, for each edge of the tree, both sides are aligned anew and kept if that scores more, until
    nothing does or after so many ``passes``.
    """
    n = len(profiles)
    if n == 1:
        return [np.arange(len(profiles[0]))]
    score = score_matrix(profiles[0].shape[1])
    merges = guide_tree(distances(profiles), np.array([max(p.sum(axis=1).max(initial=1), 1) for p in profiles]))
    blocks, members = {k: p[None] for k, p in enumerate(profiles)}, {k: [k] for k in range(n)}
    for k, (a, b) in enumerate(merges):
        blocks[n + k], _ = _joined(blocks.pop(a), blocks.pop(b), score)
        members[n + k] = members[a] + members[b]
    block = np.empty_like(blocks[2 * n - 2])
    block[members[2 * n - 2]] = blocks[2 * n - 2]
    for _ in range(passes if n > 2 else 0):
        better = False
        for side in list(members.values())[:-1]:
            inside = np.zeros(n, bool)
            inside[side] = True
            a, b = block[inside], block[~inside]
            before = float((a.sum(axis=0) @ score * b.sum(axis=0)).sum())
            new, after = _joined(_dense(a), _dense(b), score)
            if after > before + 1e-6:
                block = np.empty_like(new)
                block[inside], block[~inside] = new[: inside.sum()], new[inside.sum() :]
                better = True
        if not better:
            break
    block = _dense(block)
    return [np.flatnonzero(x[:, :-1].any(axis=1)) for x in block]
