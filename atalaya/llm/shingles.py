"""Word shingles of many texts at once, as hashed numbers, and consistent weighted samples.

Words are what white space (ASCII) separates, in lower case. A shingle is five words in a row; a
text of one to four words has one shingle of all its words, an empty one has none.
"""

from __future__ import annotations

import numpy as np

WORDS = 5
_ODD = 0x9E3779B97F4A7C15
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit numbers, one to one."""
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[:1] = 1
    return np.cumprod(out, dtype=_U)


_BYTE = mix(np.arange(256, dtype=_U) + _U(_ODD))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_INVERSE = pow(_ODD, -1, 1 << 64)
_TABLES: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of an odd number and of its inverse, modulo 2^64; kept per worker."""
    if len(_TABLES.get("up", ())) < n:
        size = max(n, 1 << 20)
        _TABLES["up"], _TABLES["down"] = _powers(size, _ODD), _powers(size, _INVERSE)
    return _TABLES["up"][:n], _TABLES["down"][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """h[i]: sum over j < i of byte hash times power j. A substring's hash follows from two of them."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, _U)
    np.cumsum(_BYTE[data] * up[:-1], out=out[1:])
    return out


def shingle_hashes(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, text after text, and how many each text has (repeats included)."""
    data = np.frombuffer(" ".join([t.lower() for t in texts]).encode("utf-8", "surrogatepass") + b" ", np.uint8)
    space = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts = edge[~space[edge]] if len(edge) else edge
    if len(data) and not space[0]:
        starts = np.concatenate([[0], starts])
    ends = edge[space[edge]] if len(edge) else edge
    h = prefix_hash(data)
    _, down = powers(len(data) + 1)
    word = mix((h[ends] - h[starts]) * down[starts])
    # A text's words: those that start before its end.
    sizes = np.fromiter((len(t.lower().encode("utf-8", "surrogatepass")) + 1 for t in texts), np.int64, len(texts))
    first = np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]))
    n_words = np.diff(first)
    n = np.where(n_words >= words, n_words - words + 1, (n_words > 0).astype(np.int64))
    odd = _powers(words + 1, _ODD)
    if len(word) >= words:
        rolled = sum(word[k : len(word) - words + 1 + k] * odd[k + 1] for k in range(words))
    else:
        rolled = np.zeros(0, _U)
    at = first[:-1]
    total = np.cumsum(n)
    index = np.repeat(at - (total - n), n) + np.arange(int(total[-1]) if len(total) else 0)
    out = np.zeros(len(index), _U)
    long_ = np.repeat(n_words >= words, n)
    out[long_] = rolled[index[long_]]
    for t in np.flatnonzero((n_words > 0) & (n_words < words)):
        own = word[at[t] : at[t] + n_words[t]]
        out[total[t] - 1] = (own * odd[1 : len(own) + 1]).sum(dtype=_U) + _U(n_words[t])
    return mix(out), n


#: Low bits of a sort key that name the shingle; the bits above name the text.
_TERM_BITS = 48
#: A term's count is cut into parts of at most this size. Equal parts keep the rate of agreement unbiased where bins are sparse.
PART = 1


def weighted_terms(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, distinct shingle, how often) for up to 65,536 texts, by text and shingle."""
    text = np.repeat(np.arange(len(counts), dtype=_U), counts)
    keys = np.sort((text << _U(_TERM_BITS)) | (hashes >> _U(64 - _TERM_BITS)))
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(new)
    keys = keys[at]
    return (keys >> _U(_TERM_BITS)).astype(np.int64), keys & _U((1 << _TERM_BITS) - 1), np.diff(np.append(at, len(new)))


def in_parts(
    text: np.ndarray, term: np.ndarray, count: np.ndarray, part: int = PART
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each count cut into parts of at most `part`, as terms of their own.

    The sums of minima and maxima over two texts stay as they are, and no single term outweighs
    the others, which would leave a heavy term to one bin of a signature. The last array
    tells from which term each part comes.
    """
    times = -(-count // part)
    source = np.repeat(np.arange(len(term)), times)
    number = np.arange(len(source)) - np.repeat(np.cumsum(times) - times, times)
    own = term[source] + number.astype(_U) * _U(_ODD)
    return text[source], own, np.minimum(count[source] - number * part, part), source


def _uniform(x: np.ndarray, salt: int) -> np.ndarray:
    """In (0, 1), from hashes."""
    return ((mix(x ^ _U(salt)) >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53


def consistent_samples(
    text: np.ndarray, term: np.ndarray, weight: np.ndarray, texts: int, bins: int, seed: int = 0
) -> np.ndarray:
    """Signature matrix (texts x bins) of improved consistent weighted sampling.

    Terms are dealt to `bins` by hash, and each bin holds one consistent weighted sample of its
    terms: with r, c from Gamma(2, 1) and b uniform, all drawn from the term's hash,
    t = floor(ln w / r + b), ln y = r (t - b), ln a = ln c - ln y - r, the term of least a is
    taken together with its t. An empty bin takes over the sample of the first filled bin on a
    fixed random walk. Two texts agree in a bin with the probability of their generalised
    Jaccard similarity. A text without terms has zeros only.
    """
    salt = (seed * 0x632BE59BD9B4E019 + 0x1234567) & (2**64 - 1)
    base = mix(term + _U(salt))
    which = (mix(base ^ _U(0x5851F42D4C957F2D)) % _U(bins)).astype(np.int64)
    r = -np.log(_uniform(base, 0xA0761D6478BD642F) * _uniform(base, 0xE7037ED1A0B428DB))
    c = -np.log(_uniform(base, 0x8EBC6AF09C88C6E3) * _uniform(base, 0x589965CC75374CC3))
    b = _uniform(base, 0x1D8E4E27C47D124F)
    t = np.floor(np.log(weight) / r + b)
    score = np.log(c) - r * (t - b) - r
    sample = mix(base ^ (t.astype(np.int64).view(_U) * _U(_ODD))) | _U(1)
    cell = text * bins + which
    best = np.full(texts * bins, np.inf)
    np.minimum.at(best, cell, score)
    out = np.zeros(texts * bins, _U)
    hit = score == best[cell]
    np.maximum.at(out, cell[hit], sample[hit])
    out = out.reshape(texts, bins)
    empty = out == 0
    some = ~empty.all(axis=1)
    step = 0
    taken = out.copy()
    while True:
        open_rows = np.flatnonzero((taken == 0).any(axis=1) & some)
        if not len(open_rows):
            return taken
        # The walk of bin j: a fixed random permutation round after round.
        walk = (mix(np.arange(bins, dtype=_U) * _U(_ODD) + _U(salt + step * 0x2545F4914F6CDD1D & 2**64 - 1)) % _U(bins)).astype(np.int64)
        part = taken[open_rows]
        part = np.where(part == 0, out[open_rows][:, walk], part)
        taken[open_rows] = part
        step += 1
        if step > 64 * bins:  # every bin has met a filled one long before
            raise RuntimeError("random walk over the bins did not end")


#: Darts beyond ln(bins) that a bin gets on average; a text of which a bin stays empty is looked at further.
_SPARE = 3.0
#: Terms and darts that are worked on at once.
_AT_ONCE = 400_000


def dart_samples(text: np.ndarray, term: np.ndarray, weight: np.ndarray, texts: int, bins: int, seed: int = 0) -> np.ndarray:
    """Signature matrix (texts x bins) of independent consistent weighted samples, exact for any number of terms.

    Darts fall on (weight, rank, bin) of each term as a Poisson process drawn from the term's hash; a
    text sees those below its term's weight, and each bin takes the dart of least rank. So two texts
    agree in a bin with the probability of their weighted Jaccard similarity, in every bin independently, and
    a text costs its terms and about bins * ln(bins) darts. `text` is sorted. A text without terms has zeros only.
    """
    out = np.zeros((texts, bins), _U)
    many = np.bincount(text, minlength=texts)
    work = np.cumsum(many + np.where(many > 0, int(bins * (np.log(bins) + 2 * _SPARE)), 0))
    total = np.bincount(text, weight, texts)
    first = np.concatenate([[0], np.cumsum(many)])
    low = 0
    while low < texts:
        done = work[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(work, done + _AT_ONCE, side="right")))
        part = slice(first[low], first[high])
        own, names, heavy = text[part] - low, term[part], weight[part]
        reach = (np.log(bins) + _SPARE) / np.where(total[low:high] > 0, total[low:high], 1)
        got = _darts(own, names, heavy, high - low, bins, reach, seed)
        while True:
            again = (got == 0).any(axis=1) & (many[low:high] > 0)
            if not again.any():
                break
            reach *= 1.5
            some, place = again[own], np.cumsum(again) - 1
            got[again] = _darts(place[own[some]], names[some], heavy[some], int(again.sum()), bins, reach[again], seed)
        out[low:high] = got
        low = high
    return out


def _darts(text: np.ndarray, term: np.ndarray, weight: np.ndarray, texts: int, bins: int, reach: np.ndarray, seed: int) -> np.ndarray:
    """For each bin the dart of least rank below the text's `reach`, as a number; zero if there is none."""
    # A term's weight axis is cut at 2, 4, 8 ...; the darts of a piece come in the order of their rank.
    pieces = np.maximum(1, np.ceil(np.log2(weight))).astype(np.int64)
    of = np.repeat(np.arange(len(term)), pieces)
    piece = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    width = np.exp2(np.maximum(piece, 1))
    floor = np.where(piece > 0, width, 0.0)
    salt = (seed * 0x632BE59BD9B4E019 + 0x2545F4914F6CDD1D) & (2**64 - 1)
    base = mix(mix(term + _U(salt))[of] + piece.astype(_U) * _U(0xD1342543DE82EF95))
    row, share = text[of], (weight[of] - floor) / width
    rate, limit = bins * width, reach[row]
    rank, drawn = np.zeros(len(of)), np.zeros(len(of), np.int64)
    best, out = np.full(texts * bins, np.inf), np.zeros(texts * bins, _U)
    left = np.arange(len(of))
    while len(left):
        mean = (limit[left] - rank[left]) * rate[left]
        n = (mean + np.sqrt(mean)).astype(np.int64) + 1
        end = np.cumsum(n)
        each = np.repeat(left, n)
        number = np.arange(end[-1]) - np.repeat(end - n - drawn[left], n)
        dart = mix(base[each] + number.astype(_U) * _U(_ODD))
        gap = -np.log(((dart >> _U(32)).astype(np.float64) + 0.5) * 2.0**-32) / rate[each]
        run = np.cumsum(gap)
        at = run - np.repeat(run[end - n] - gap[end - n] - rank[left], n)
        rank[left], drawn[left] = at[end - 1], drawn[left] + n
        see = np.flatnonzero(at < limit[each])
        dart, at, each = dart[see], at[see], each[see]
        part = np.flatnonzero(share[each] < 1)
        above = _uniform(dart[part], 0x8EBC6AF09C88C6E3) >= share[each[part]]
        keep = np.ones(len(each), bool)
        keep[part[above]] = False
        dart, at, each = dart[keep], at[keep], each[keep]
        cell = row[each] * bins + (((dart & _U(0xFFFFFFFF)) * _U(bins)) >> _U(32)).astype(np.int64)
        np.minimum.at(best, cell, at)
        hit = at == best[cell]
        out[cell[hit]] = mix(dart[hit] ^ _U(0x5851F42D4C957F2D)) | _U(1)
        left = left[rank[left] < limit[left]]
    return out.reshape(texts, bins)


def batch_signatures(texts: list[str], bins: int, seed: int = 0) -> np.ndarray:
    """Signatures of texts by their shingles' counts."""
    hashes, counts = shingle_hashes(texts)
    text, term, weight, _ = in_parts(*weighted_terms(hashes, counts))
    return consistent_samples(text, term, weight.astype(np.float64), len(texts), bins, seed)
