"""Plain versions of what the operators compute, written from their descriptions."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
STOCK = ["all rights reserved", "privacy policy", "click here", "use cookies", "tous droits réservés"]  # of the phrases, those that the tests use


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def shingles(text, k=5):
    w = WORD.findall(low(text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    label = {i: i for i, _ in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in sets:
        for j, b in sets:
            if i < j and a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((find(i), find(j)))
                label[y] = x
    return {i: find(i) for i, _ in sets}


def bad_line(line, earlier):
    w = WORD.findall(line)
    if not w:
        return False
    if line in earlier:
        return True
    solid = sum(map(len, w))
    loud = sum(bool(re.search(r"(?:[!?]{2,}|[#*$%&<>])$", x)) for x in w)
    seps = sum(bool(re.fullmatch("[|>»›·•/]+", x)) for x in w)
    if 2 * loud >= len(w) or 5 * sum(c in "#*$%&|<>" for c in line) >= solid:
        return True
    if len(w) >= 10 and not any(c in ".,;:!?…。、！？，" for c in line):
        return True
    if 3 * seps >= len(w) or (seps >= 2 and len(w) - seps <= 3 * (seps + 1)):
        return True
    if len(w) >= 4 and 3 * sum(a == b for a, b in zip(w, w[1:])) >= 2 * len(w):
        return True
    stock = sum(len(p) for p in STOCK if p in line.lower())
    return 10 * stock >= len(line) and stock > 0


def quality(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lost_chars, base_failed, kept, clean text)"""
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
    count = {}
    for x in windows:
        count[x] = count.get(x, 0) + 1
    again = {k + j for k, x in enumerate(windows) if count[x] > 1 for j in range(8)}
    fine, lost, dup, earlier = [], 0, 0, set()
    for line in text.split("\n"):
        dup += bool(WORD.search(line)) and line in earlier
        if bad_line(line, earlier):
            lost += sum(map(len, WORD.findall(line)))
        else:
            fine.append(line)
        earlier.add(line)
    chars = sum(map(len, w))
    failed = len(w) < 20 or 100 * len(again) > 30 * len(w)
    return len(w), chars, sum(c in "#*$%&|<>" for c in text), dup, len(again), lost, failed, not failed and 100 * lost <= 40 * chars, "\n".join(fine)


def leaks(rows, items):
    """similarity of the best window for each (row id, item id) that is similar enough"""
    found = {}
    for i, text in rows:
        w = WORD.findall(low(text or ""))
        for item, t in items:
            own = WORD.findall(low(t or ""))
            k = min(5, len(own))
            if not own or len(w) < k:
                continue
            b = [tuple(own[j : j + k]) for j in range(len(own) - k + 1)]
            for s in range(max(1, len(w) - len(own) + 1)):
                part = w[s : s + len(own)]
                a = [tuple(part[j : j + k]) for j in range(len(part) - k + 1)]
                same = sum(min(a.count(x), b.count(x)) for x in set(a))
                if same and 100 * same >= 75 * (len(a) + len(b) - same):
                    found[i, item] = max(found.get((i, item), 0), same / (len(a) + len(b) - same))
    return found


def draw(*parts):
    return int(hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()[:10], 16)


def feistel(symbols, alphabets, key, kind):
    """symbols: numbers; alphabets: (first character, size) of each position"""
    first = [ord(a) for a, _ in alphabets]
    size = [n for _, n in alphabets]
    x = [ord(c) - f for c, f in zip(symbols, first, strict=True)]
    half = len(x) // 2
    word = lambda a, b: "".join(chr(first[i] + x[i]) for i in range(a, b))
    for turn in range(1, 7):
        a, b, other = (half, len(x), word(0, half)) if turn % 2 == 0 else (0, half, word(half, len(x)))
        x[a:b] = [(x[i] + draw(key, kind, turn, i - a + 1, other)) % size[i] for i in range(a, b)]
    return word(0, len(x))


def feistel_pair(a, b, sizes, key, kind):
    for turn in range(1, 7):
        if turn % 2 == 0:
            b = (b + draw(key, kind, turn, 0, a)) % sizes[1]
        else:
            a = (a + draw(key, kind, turn, 0, b)) % sizes[0]
    return a, b


def luhn(n):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(n))) % 10 == 0


def card(digits, key):
    body = digits[0] + feistel(digits[1:-1], [("0", 10)] * (len(digits) - 2), key, "card")
    return next(body + str(c) for c in range(10) if luhn(body + str(c)))


def ipv4(address, key):
    o = [int(x) for x in address.split(".")]
    a, b = feistel_pair(o[0] * 256 + o[1], o[2] * 256 + o[3], (65536, 65536), key, "ipv4")
    return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"


def email(address, key):
    local, domain = address.split("@")
    signs = [c for c in local if c.isascii() and c.isalnum()]
    new = iter(feistel("".join(signs).lower(), [("0", 10) if c.isdigit() else ("a", 26) for c in signs], key, "email"))
    return "".join((lambda n: n.upper() if c.isupper() else n)(next(new)) if c.isascii() and c.isalnum() else c for c in local) + "@" + domain


def phone(national, key):
    """ten digits as of North America"""
    two = ("2", 8)
    ten = ("0", 10)
    return feistel(national, [two, ten, ten, two] + [ten] * 6, key, "phone")


def date(iso, key):
    from datetime import date, timedelta

    n = (date.fromisoformat(iso) - date(1800, 1, 1)).days
    a, b = feistel_pair(n // 773, n % 773, (189, 773), key, "date")
    return (date(1800, 1, 1) + timedelta(days=a * 773 + b)).isoformat()
