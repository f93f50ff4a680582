"""Plain Python versions of the contracts, for small tables."""

import datetime
import hashlib
import hmac
import re
import string

WS = " \t\n\x0b\f\r"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def words(t):
    return re.findall(f"[^{WS}]+", t or "")


def lines(rows):
    """(doc_id, text) rows to {doc_id: (n_lines, n_dropped, kept_sha256)}."""
    key = lambda x: x.strip(WS).translate(UPPER)
    seen = {}
    for n, (_, t) in enumerate(rows):
        for k in {key(x) for x in (t or "").split("\n")}:
            seen.setdefault(k, set()).add(n)
    bad = {k for k, v in seen.items() if len(v) >= 10 and k}
    out = {}
    for d, t in rows:
        ls = (t or "").split("\n")
        kept = [x for x in ls if key(x) not in bad]
        out[d] = (len(ls), len(ls) - len(kept), sha("\n".join(kept)))
    return out


def quality_base(t):
    t = t or ""
    w = words(t)
    ls = [x for x in t.split("\n") if x.strip(WS)]
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i : i + 8]), []).append(i)
    hit = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(8)}
    failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), len(ls) - len(set(ls)), len(hit), failed


def secrets(t):
    t = t or ""
    found = []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.A):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    for m in re.finditer(r"AKIA[A-Z0-9]+", t):
        if len(m[0]) >= 20:
            found.append((m.start(), 1, f"access:{m.start()}:{m.end()}"))
    for m in re.finditer(r"[0-9a-f]+", t):
        if len(m[0]) >= 24:
            found.append((m.start(), 2, f"hex:{m.start()}:{m.end()}"))
    kinds = [k for _, k, _ in found]
    return kinds.count(0), kinds.count(1), kinds.count(2), sha(",".join(x for _, _, x in sorted(found)))


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """{source: size} to {source: target}, by dealing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(order), {}
    while open_:
        rate = left / sum(w[s] for s in open_)
        over = {s for s in open_ if rate * w[s] > most * sizes[s]}
        if not over:
            return out | {s: rate * w[s] for s in open_}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def bench_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(UPPER))


def contaminated(docs, items, window=10):
    """{doc_id: (n_words, n_hit, n_items, items_sha256, contaminated)}."""
    phrases = {}
    for i, t in items:
        w = bench_words(t)
        for k in range(max(len(w) - window + 1, 1) if w else 0):
            phrases.setdefault(tuple(w[k : k + window]), set()).add("null" if i is None else str(i))
    lengths = {len(p) for p in phrases}
    out = {}
    for d, t in docs:
        w, hit, found = bench_words(t), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if owners := phrases.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= owners
        out[d] = (len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit))
    return out


class Pseudonyms:
    """Personal data of a text replaced, one value at a time."""

    def __init__(self, master):
        self.master = master

    def noise(self, kind, *parts):
        key = hmac.new(self.master.encode(), kind.encode(), "sha256").digest()
        return int(hmac.new(key, "|".join(map(str, parts)).encode(), "sha256").hexdigest()[:15], 16)

    def feistel(self, kind, x, y, m, n):
        for i in range(1, 11):
            x, y, m, n = y, (x + self.noise(kind, m, n, i, y)) % m, n, m
        return x, y

    def digits(self, kind, d):
        u = len(d) // 2
        if not u:
            return d
        a, b = self.feistel(kind, int(d[:u]), int(d[u:]), 10**u, 10 ** (len(d) - u))
        return f"{a:0{u}}{b:0{len(d) - u}}"

    def local(self, s):
        def shifted(s, by, r):
            out = ""
            for i, c in enumerate(s):
                al = next((al for al in (string.ascii_lowercase, string.ascii_uppercase, string.digits) if c in al), None)
                out += al[(al.index(c) + self.noise("email", "local", r, i, by)) % len(al)] if al else c
            return out

        x, y = s[: len(s) // 2], s[len(s) // 2 :]
        for r in range(1, 6):
            x = shifted(x, y, r)
            y = shifted(y, x, r)
        return x + y

    def day(self, d, fits):
        x = d
        while True:
            a, b = self.feistel("date", x // 270, x % 270, 271, 270)
            x = a * 270 + b
            if x < 73049 and fits(datetime.date(1900, 1, 1) + datetime.timedelta(x)):
                return datetime.date(1900, 1, 1) + datetime.timedelta(x)

    def value(self, kind, s):
        d = re.sub("[^0-9]", "", s)
        laid = lambda s, d: re.sub("[0-9]", lambda _, it=iter(d): next(it), s)
        if kind == "email":
            at = s.index("@")
            return self.local(s[:at]) + s[at:]
        if kind == "card":
            luhn = lambda d: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10
            p = d[0] + self.digits(kind, d[1:-1])
            return laid(s, p + str(-luhn(p + "0") % 10)) if luhn(d) == 0 and int(d) else None
        if kind == "iban":
            t = s.replace(" ", "")
            mod = lambda a, check: int("".join(str(int(c, 36)) for c in a + t[:2] + check)) % 97
            if mod(t[4:], t[2:4]) != 1 or len(t) > 34:
                return None
            a = laid(t[4:], self.digits(kind, re.sub("[^0-9]", "", t[4:])))
            return laid(s, f"{98 - mod(a, '00'):02}" + re.sub("[^0-9]", "", a))
        if kind == "ip":
            q = [int(x) for x in s.split(".")]
            a, b = self.feistel(kind, q[0] * 256 + q[1], q[2] * 256 + q[3], 65536, 65536) if max(q) < 256 else (0, 0)
            return ".".join(map(str, (a // 256, a % 256, b // 256, b % 256))) if max(q) < 256 else None
        if kind == "phone":
            k = max(len(d) - 10, 0)
            return laid(s, d[:k] + self.digits(kind, d[k:]))
        if kind == "ssn":
            bad = lambda s: re.search("^(000|666|9..)-|-00-|-0000$", s)
            out = None if bad(s) else laid(s, self.digits(kind, d))
            while out and bad(out):
                out = laid(s, self.digits(kind, out.replace("-", "")))
            return out
        day_first = {"-": "%Y-%m-%d", "/": "%d/%m/%Y", ".": "%d.%m.%Y"}["/" if "/" in s else "." if "." in s else "-"]
        for layout, fits in [(day_first, lambda x: True)] + [("%m/%d/%Y", lambda x: x.day > 12)] * ("/" in s):
            try:
                x = datetime.datetime.strptime(s, layout).date()
            except ValueError:
                continue
            return self.day((x - datetime.date(1900, 1, 1)).days, fits).strftime(layout) if 1900 <= x.year < 2100 else None

    def text(self, t, kinds):
        """The text with pseudonyms; kinds: name to pattern, the first that is the whole match says what it is."""

        def one(m):
            for kind, p in kinds.items():
                if (x := re.compile(p, re.A).match(m[0])) and x[0] == m[0]:
                    return self.value(kind.split("_")[0], m[0]) or m[0]

        return t and re.sub("|".join(f"(?:{p})" for p in kinds.values()), one, t, flags=re.A)
