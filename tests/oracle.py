"""A slow trainer, to hold the others against: every pair counted anew for every merge."""

from collections import Counter


def slow_train(words, num_merges):
    words, out = [(list(w), n) for w, n in words], []
    while len(out) < num_merges:
        pairs = Counter()
        for w, n in words:
            if n:
                for p in zip(w, w[1:]):
                    pairs[p] += n
        pairs = {p: n for p, n in pairs.items() if n > 0}
        if not pairs:
            break
        p = min(pairs, key=lambda p: (-pairs[p], p))
        new = 256 + len(out)
        out.append((*p, pairs[p]))
        for k, (w, n) in enumerate(words):
            merged, i = [], 0
            while i < len(w):
                if tuple(w[i : i + 2]) == p:
                    merged.append(new)
                    i += 2
                else:
                    merged.append(w[i])
                    i += 1
            words[k] = (merged, n)
    return out, [w for w, _ in words]
