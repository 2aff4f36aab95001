"""Plain forms of the string similarities, one pair at a time: what the batch kernels must equal."""


def lcs(a, b):
    rows = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, rows[j] = rows[j], before + 1 if x == y else max(rows[j], rows[j - 1])
    return rows[-1]


def indel(a, b):
    return 2 * lcs(a, b) / (len(a) + len(b)) if a and b else 0.0


def token_sort(a, b):
    return indel(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a, b):
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    left, right = (" ".join(w for w in (both, " ".join(sorted(d))) if w) for d in (x - y, y - x))
    if both and (left == both or right == both):
        return 1.0
    return max(indel(left, right), indel(both, left), indel(both, right))


def partial(a, b):
    if not a or not b:
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    n = len(a)
    return max(indel(a, b[max(0, i) : i + n]) for i in range(1 - n, len(b)))


def partial_token(a, b):
    if set(a.split()) & set(b.split()):
        return 1.0
    return partial(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def weighted(a, b):
    if not a or not b:
        return 0.0
    base, longer = indel(a, b), max(len(a), len(b)) / min(len(a), len(b))
    if longer < 1.5:
        return max(base, 0.95 * max(token_sort(a, b), token_set(a, b)))
    scale = 0.9 if longer <= 8 else 0.6
    return max(base, scale * partial(a, b), 0.95 * scale * partial_token(a, b))


def jaro(a, b):
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free, left = [True] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == c:
                free[j] = False
                left.append(c)
                break
    if not left:
        return 0.0
    right = [c for c, f in zip(b, free, strict=True) if not f]
    m, moved = len(left), sum(x != y for x, y in zip(left, right, strict=True)) // 2
    return (m / len(a) + m / len(b) + (m - moved) / m) / 3


def jaro_winkler(a, b):
    base = jaro(a, b)
    if base <= 0.7:
        return base
    same = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        same += 1
    return base + 0.1 * same * (1 - base)
