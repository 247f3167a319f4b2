"""Row-multiset comparison used by the oracle tests (mirrors tools/check_oracle.py)."""

import math


def norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        return (1, "nan") if math.isnan(v) else (2, v)
    if isinstance(v, bool):
        return (2, float(v))
    if isinstance(v, int):
        return (2, float(v))
    return (4, str(v))


def rows_of(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in records)


def same(a, b, rel=1e-6, abs_=2e-6):
    if len(a) != len(b):
        return False
    for x, y in zip(a, b):
        for u, v in zip(x, y):
            if u[0] != v[0]:
                return False
            if u[0] == 2:
                if not math.isclose(u[1], v[1], rel_tol=rel, abs_tol=abs_):
                    return False
            elif u != v:
                return False
    return True
