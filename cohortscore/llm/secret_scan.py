"""Secret scan: candidate strings, judged by a random forest that is trained from labelled findings."""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Candidates of four kinds. Runs of key characters, at least 16 long.
RUN = re.compile(r"[A-Za-z0-9+/_\-.@=]{16,}")
#: Private key blocks from BEGIN to END with all that stands between, else with headers and what may be key body.
BLOCK = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?)-----(?:(?:(?!-----BEGIN )[\s\S])*?-----END \1-----|(?:\s*[A-Za-z][A-Za-z-]*: [^\n]*)*[A-Za-z0-9+/=\s\\]*)")
#: The password in a URL.
URL = re.compile(r"://[^\s/:@\"'<>]*:([^\s/\"'<>]+)@")
#: Formats of known issuers. Fixed values.
KNOWN = re.compile(r"AKIA[0-9A-Z]{16}$|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_\-]{35}|eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+|-----BEGIN")
#: Neighbouring words that speak for a secret, and against. Fixed values.
FOR = ("token", "secret", "password", "passwd", "pwd", "key", "apikey", "api_key", "access", "auth", "bearer", "authorization", "credential", "credentials", "private", "client_secret", "signature")
#: A name with a word of FOR that a value is assigned to, and the value: whole if quoted, else up to white space.
_FOR = "|".join(sorted(FOR, key=len, reverse=True))
_CAMEL = "|".join(w.capitalize() for w in sorted(FOR, key=len, reverse=True))
NAME = rf"(?:(?<![A-Za-z])(?i:{_FOR})|(?<=[a-z])(?:{_CAMEL}))s?(?:[_\-.][A-Za-z0-9_\-.]{{0,40}})?(?:\\?[\"'`\]])?(?:[ \t]*(?::=|=>|={{1,3}}|:)[ \t]*|[ \t]+(?i:is|bearer|basic)[ \t]+|(?<=earer)[ \t]+|(?<=EARER)[ \t]+|[ \t]+(?=[\"'`]))(?:(?i:bearer|basic|token)[ \t]+)?"
VALUE = re.compile(NAME + r"""(?:\\"((?:[^"\\\n]|\\[^"\n])+)\\"|\\'((?:[^'\\\n]|\\[^'\n])+)\\'|"((?:[^"\\\n]|\\.)+)"|'((?:[^'\\\n]|\\.)+)'|`([^`\n]+)`|["'`]?(?P<open>[^\s"'`]))""")
#: Where a value without quotes ends.
END = re.compile(r"\s|\Z")
NAMED = re.compile(NAME + r"""\\?["'`]?$""")
AGAINST = ("commit", "sha", "sha1", "sha256", "md5", "checksum", "hash", "digest", "etag", "uuid", "guid", "id", "revision", "version", "build", "order", "invoice", "isbn", "example", "sample", "dummy", "placeholder", "test", "file", "path", "url", "mail", "email", "contact")
#: Words whose letters count as dictionary coverage. Fixed values.
WORDS = ("the", "and", "for", "that", "with", "this", "from", "have", "user", "name", "data", "file", "image", "page", "index", "report", "test", "example", "sample", "value", "order", "server", "client", "service", "system", "table", "model", "config", "version", "release", "build", "home", "public", "static", "assets", "content", "upload", "download", "mail", "news", "blog", "article", "product", "your", "here", "change", "placeholder", "password", "secret", "token", "key", "main", "master", "branch", "module", "class", "number", "string", "level", "group", "final", "draft", "summary", "meeting", "project", "team", "und", "der", "die", "les", "des", "pour", "para", "con", "los", "una")
DICTIONARY = re.compile("|".join(sorted(WORDS, key=len, reverse=True)))
NAMES = ("length", "log_letters", "digits", "upper", "hex_only", "entropy", "class_changes", "transition", "coverage", "path_parts", "extension", "known", "for_before", "against_before", "assigned", "quoted", "at_sign", "for_line", "against_line", "distinct", "named", "in_url", "symbols", "spaces", "template", "password_name", "digit_count", "identifier")
#: Labelled findings made for training, trees, and their depth.
LABELLED, TREES, DEPTH, VERDICT = 3_000, 40, 9, 0.5


#: What stands where a value is filled in later. Fixed values.
TEMPLATE = re.compile(r"[<$%{\[(]|(?:null|none|nil|true|false|undefined|required|optional|changeme|change_me|redacted|hidden|password|secret|token|x++|\*++|\.++)\W*+$|(?:your|my|the|example|test|dummy|sample)[-_ ]|[a-z_]+(?:\.[a-z_]+)*[\[(]", re.I)


def spans(text: str) -> list[tuple[int, int]]:
    """The candidates of a text in order. A run is cut where a value begins; a run inside a value is one of its own.

    Of values without quotes that lie in one another, those between the outermost and the innermost end where the next
    begins, so the lengths of all candidates add up to no more than a few times the text's.
    """
    blocks = [m.span() for m in BLOCK.finditer(text)]
    ends = [b for _, b in blocks]

    def free(a: int) -> bool:
        i = bisect_right(ends, a)
        return i == len(blocks) or a < blocks[i][0]

    values = set()
    bare: list[int] = []  # where values without quotes begin that share one end
    at = end = 0

    def close() -> None:
        """Of values that lie in one another the first and the last are whole, each between ends where the next begins."""
        inner = bare[1:-1]
        values.update(zip([*bare[:1], *inner, *bare[-1:]], [end, *bare[2:], end] if len(bare) > 1 else [end]))

    while m := VALUE.search(text, at):  # on from the value's start, as a value can hold a name and its own value
        a, b = m.span(m.lastindex)
        if m["open"] is None:
            values.add((a, b))
        else:
            if a >= end:
                close()
                bare, end = [], END.search(text, a).start()
            bare.append(a)
        at = max(a, m.start() + 1)
    close()
    values.update(m.span(1) for m in URL.finditer(text))
    begins = sorted({a for a, _ in values})
    runs = set()
    for m in RUN.finditer(text):
        a, b = m.span()
        cuts = [a, *begins[bisect_right(begins, a) : bisect_left(begins, b)], b]
        runs.update((x, y) for x, y in zip(cuts[:-1], cuts[1:]) if y - x >= 16 or len(cuts) == 2)
    return sorted([*blocks, *((a, b) for a, b in values | runs if free(a))])


def features(text: str, a: int, b: int, transitions: np.ndarray) -> list[float]:
    """The statistics of NAMES for the whole of text[a:b] and its neighbours on the same line, in time linear in its length."""
    s = text[a:b]
    n = len(s)
    line = text[max(0, a - 160) : a].rpartition("\n")[2]
    before = line[-60:].lower()
    after = text[b : b + 40].partition("\n")[0].lower()
    near = re.findall(r"[a-z_0-9]+", before)[-4:]
    own = re.findall(r"[a-z_]+", s.partition("=")[0].lower()) if "=" in s[:-2] else []
    codes = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    kinds = CLASSES[np.minimum(codes, 128)]
    counts = np.unique(codes, return_counts=True)[1]
    share = counts / n
    low = s.lower()
    letters = LETTERS[np.minimum(codes, 128)]
    covered = sum(len(m) for m in DICTIONARY.findall(low))
    return [
        n,
        math.log1p(int(((kinds == 1) | (kinds == 2)).sum())),
        float((kinds == 0).mean()),
        float((kinds == 2).mean()),
        float(re.fullmatch(r"[0-9a-fA-F]+", s) is not None),
        float(-(share * np.log2(share)).sum()),
        float((kinds[1:] != kinds[:-1]).sum()) / n,
        float(transitions[letters[:-1], letters[1:]].mean()) if n > 1 else 0.0,
        covered / n,
        float(s.count("/") + s.count("\\")),
        float(re.fullmatch(r"\.[A-Za-z]{2,4}", "." + s[-5:].rpartition(".")[2]) is not None and "." in s[-5:]),
        float(KNOWN.match(s) is not None),
        float(any(w in FOR for w in near[-2:] + own)),
        float(any(w in AGAINST for w in near[-2:] + own)),
        float(re.search(r"[=:]\s*[\"']?$", before) is not None),
        float(before.endswith(('"', "'")) and after.startswith(('"', "'"))),
        float("@" in s),
        float(any(w in FOR for w in near)),
        float(any(w in AGAINST for w in near) or any(w in AGAINST for w in re.findall(r"[a-z_0-9]+", after)[:2])),
        len(counts) / n,
        float(NAMED.search(line) is not None),
        float(re.search(r"://[^\s/:@]*:$", line) is not None and after.startswith("@")),
        float((kinds == 3).mean()),
        float(s.count(" ")) / n,
        float(TEMPLATE.match(s) is not None),
        float(PASSWORD_NAME.search(line) is not None),
        float((kinds == 0).sum()),
        float(IDENTIFIER.fullmatch(s) is not None),
    ]


#: A password's name just before the value, and values that look like names in code.
PASSWORD_NAME = re.compile(r"""(?:pass(?:word|wd)|pwd|credentials?)s?[^\s:=]{0,20}["'\]\\]*\s*(?::=|=>|=|:|\bis\b|(?=["']))\s*\\?["'`]?$""", re.I)
IDENTIFIER = re.compile(r"[A-Za-z]+(?:[_\-.][A-Za-z]+)+\W?|[a-z]+(?:[A-Z][a-z]+)+|[a-z]+")

#: By code below 128: digit 0, lower 1, upper 2, else 3; and the letter's number or 0. 128 stands for all others.
CLASSES = np.array([0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3 for c in map(chr, range(128))] + [3])
LETTERS = np.array([ord(c.lower()) - 96 if c.isalpha() else 0 for c in map(chr, range(128))] + [0])


def labelled_findings(n: int = LABELLED, seed: int = 0) -> list[tuple[str, int, int, int]]:
    """(text, from, to, label): findings with known verdicts, drawn from the formats that keys and their look-alikes have."""
    rng = random.Random(seed)
    hexa, alnum = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    word = lambda: rng.choice(WORDS) if rng.random() < 0.4 else "".join(rng.choice(("an", "re", "th", "in", "er", "on", "ti", "es", "ch", "ou", "é", "ü", "ción")) for _ in range(rng.randint(1, 4)))
    of = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    key = lambda: rng.choice((lambda: of(hexa, rng.choice((32, 40, 64))), lambda: of(alnum, rng.randint(20, 48)), lambda: of(alnum + "+/", rng.randint(24, 64)) + "=" * rng.randint(0, 2), lambda: "AKIA" + of(alnum[:26] + "0123456789", 16), lambda: "ghp_" + of(alnum, 36), lambda: "sk_live_" + of(alnum, 24), lambda: f"xoxb-{of('0123456789', 11)}-{of(alnum, 24)}"))()
    upper, lower, b64 = alnum[:26], alnum[26:52], alnum + "+/"
    syllables = lambda a, b: "".join(rng.choice(("an", "re", "th", "in", "er", "on", "ti", "es", "ch", "ou", "st", "ver")) for _ in range(rng.randint(a, b)))
    passwords = ("password", "passwd", "pwd", "db_password", "PASSWORD", "userPassword", "secret", "credentials")
    name_of = lambda: rng.choice((*FOR, *passwords, "auth_token", "apiKey", "SECRET_KEY"))

    def password() -> str:
        kind = rng.randrange(5)
        if kind == 4:
            return (rng.choice(WORDS) if rng.random() < 0.3 else syllables(1, 4)) + of("0123456789", rng.randint(0, 4))
        if kind == 0:
            return of(alnum + "!#%&*+-?@^~", rng.randint(8, 20))
        if kind == 1:
            s = rng.choice((syllables(2, 4), *WORDS))
            s = "".join(rng.choice({"a": "4@", "e": "3", "o": "0", "i": "1!", "s": "5"}.get(c, c)) if rng.random() < 0.5 else c for c in s)
            return (s.capitalize() if rng.random() < 0.6 else s) + rng.choice(("", "&", "-", "_")) + of("0123456789", rng.randint(1, 4)) + rng.choice(("", "!", "xyz!", "#", "?"))
        if kind == 2:
            return of(lower + "0123456789", rng.randint(6, 15))
        return " ".join(syllables(2, 3) for _ in range(rng.randint(3, 5))) + of("0123456789!", 2)

    def block() -> str:
        body = "\n".join(of(b64, 64) for _ in range(rng.randint(2, 12))) + "\n" + of(b64, rng.randint(1, 60))
        kind = rng.choice(("RSA PRIVATE KEY", "PRIVATE KEY", "EC PRIVATE KEY", "OPENSSH PRIVATE KEY", "ENCRYPTED PRIVATE KEY", "PGP PRIVATE KEY BLOCK"))
        head = "Version: GnuPG v2\n\n" if "PGP" in kind else rng.choice(("", f"Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,{of(hexa.upper(), 32)}\n\n"))
        return f"-----BEGIN {kind}-----\n{head}{body}\n-----END {kind}-----"

    def more_secrets() -> tuple[str, str, str]:
        """(what stands before, secret, what stands after): passwords, keys of letters alone, tokens, URL passwords, key blocks."""
        kind, q = rng.randrange(6), rng.choice(('"', "'"))
        eq = rng.choice((" = ", ": ", "=", ":"))
        if kind == 0:
            return f"{rng.choice(passwords)}{eq}{q}", password(), q
        if kind == 1:
            return f"{rng.choice(passwords)}{rng.choice((eq, ' is '))}", password().replace(" ", "-"), ""
        if kind == 2:
            s, q = of(rng.choice((upper, lower, upper + lower)), rng.randint(16, 40)), rng.choice((q, ""))
            return f"{name_of()}{eq}{q}", s, q
        if kind == 3:
            return rng.choice(("", "Authorization: Bearer ", f"{name_of()}{eq}")), "eyJ" + of(alnum, rng.randint(15, 30)) + ".eyJ" + of(alnum, rng.randint(20, 80)) + "." + of(alnum + "-_", 43), ""
        if kind == 4:
            return f"{rng.choice(('postgres', 'https', 'mysql', 'amqp', 'redis'))}://{rng.choice(WORDS)}:", password().replace(" ", "-").replace("@", "."), f"@{rng.choice(WORDS)}.example.com/{rng.choice(WORDS)}"
        return "", block(), ""

    def more_others() -> tuple[str, str, str]:
        """The same for what looks like these and is none: long words, names, rules, code, values filled in later."""
        kind, q = rng.randrange(8), rng.choice(('"', "'", ""))
        plain = rng.choice(("key", "token", "auth", "access", "private", "signature", "sort_key", "secret_name", "keys", "token_type"))
        if kind == 6:  # a value that is a name
            parts = [syllables(1, 3) if rng.random() < 0.5 else rng.choice(WORDS) for _ in range(rng.randint(1, 5))]
            s = rng.choice(("_".join(parts), "-".join(parts), ".".join(parts), parts[0] + "".join(p.capitalize() for p in parts[1:]), "".join(parts)))
            return f"{plain}{rng.choice((' = ', ': ', '='))}{q}", s, q
        if kind == 7:  # code or prose
            w = [syllables(1, 3) for _ in range(4)]
            s = rng.choice((f"def {w[0]}({w[1]})", f"{w[0]} {w[1]} {w[2]}", f"{w[0]}/{w[1]}/{w[2]}", f"{w[0]}, {w[1]}", f"{w[0]}({w[1]}, {w[2]})"))
            return f"{plain}{rng.choice((' = ', ': '))}{q or chr(34)}", s, q or chr(34)
        if kind == 0:
            s = rng.choice((syllables(8, 12), syllables(8, 12).upper(), syllables(8, 12).capitalize()))
            return "", s, rng.choice(("", ".", ","))[:0]
        if kind == 1:
            parts = [rng.choice(WORDS) for _ in range(rng.randint(4, 6))]
            return "", rng.choice(("_".join(parts) + "_names", "-".join(parts) + "-names", ".".join(parts) + ".names", "".join(p.capitalize() for p in parts) + "Handler", "_".join(parts).upper() + "_NAMES")), ""
        if kind == 2:
            return "", rng.choice("-=_.") * rng.randint(16, 80), ""
        if kind == 3:
            s = rng.choice(("${DB_PASSWORD}", "<password>", "{{ secret }}", "changeme", "null", "None", "true", "********", "xxxxxxxx", "your-password-here", "your_token", "os.environ['TOKEN']", "getpass()", "%(password)s", "required", "[hidden]", "example-password", "..."))
            return f"{name_of()}{rng.choice((' = ', ': ', '='))}{q if q not in s else ''}", s, q if q not in s else ""
        if kind == 4:
            s = rng.choice((rng.choice(WORDS), syllables(1, 4), str(rng.randint(0, 9999))))
            return f"{plain}{rng.choice((': ', ' is ', ' = '))}", s + rng.choice(("", ",", ".")), ""
        return f"https://{rng.choice(('user', 'username', 'login'))}:", rng.choice(("password", "pass", "<password>", "${PASSWORD}", "secret", "xxx")), "@host.example.com/"

    out = []
    for i in range(n):
        pre, post = " ".join(word() for _ in range(rng.randint(0, 8))), " ".join(word() for _ in range(rng.randint(0, 8)))
        label = i % 2
        if rng.random() < 0.5:
            head, s, tail = more_secrets() if label else more_others()
        elif label:
            s, quote = key(), rng.choice(('"', "'", ""))
            name = rng.choice(FOR)
            head = rng.choice((f"{name} = {quote}", f"{name}: {quote}", f"{name}={quote}", f"my {name} is {quote}", f"{name.upper()} = {quote}", f"Authorization: Bearer {quote}"))
            if KNOWN.match(s) and rng.random() < 0.4:
                head = ""
            tail = quote
        else:
            kind = rng.randrange(9)
            head = tail = ""
            if kind == 0:
                s, head = of(hexa, rng.choice((32, 40, 64))), rng.choice(("commit ", "sha256: ", "md5 ", "checksum = ", "etag: ", 'digest "', "revision "))
            elif kind == 1:
                s, head = "-".join(of(hexa, k) for k in (8, 4, 4, 4, 12)), rng.choice(("id ", "uuid: ", "guid = ", "order ", ""))
            elif kind == 2:
                s = "/".join(rng.choice(WORDS) for _ in range(rng.randint(2, 5))) + f"/{rng.choice(WORDS)}{rng.randint(1, 9999)}.{rng.choice(('html', 'png', 'jpg', 'pdf', 'js'))}"
            elif kind == 3:
                s = f"{rng.choice(WORDS)}.{rng.randint(1, 99)}@mail{rng.randint(0, 99)}.example.{rng.choice(('com', 'org', 'net'))}"
            elif kind == 4:
                s, head = of("0123456789", rng.randint(16, 24)), rng.choice(("order ", "isbn ", "invoice ", "", "build "))
            elif kind == 5:
                s = "_".join(rng.choice(WORDS) for _ in range(rng.randint(3, 5))) + f"_{rng.randint(1, 2030)}"
            elif kind == 6:
                s, head = rng.choice(("x" * 20 + "1", "0" * 24, "1234567890abcdef", "your-api-key-here-1", "changeme-password-123", "example-token-000000")), rng.choice(("key = ", "token: ", "password = ", "example "))
            elif kind == 7:
                s = f"{rng.randint(1990, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}T{rng.randint(0, 23):02}-00-00.{rng.randint(0, 999):03}"
            else:
                s = ("".join(rng.choice(("an", "re", "th", "in", "er", "on", "ti", "es", "ch")) for _ in range(rng.randint(8, 14)))) + str(rng.randint(0, 99))
        text = f"{pre} {head}"
        out.append((f"{text}{s}{tail} {post}", len(text), len(text) + len(s), label))
    return out


def letter_transitions(words: tuple[str, ...] = WORDS) -> np.ndarray:
    """Log probabilities of one letter after another in dictionary words, with 0 for anything else."""
    counts = np.full((27, 27), 0.5)
    for w in words:
        codes = [ord(c) - 96 for c in w]
        np.add.at(counts, (codes[:-1], codes[1:]), 1)
    return np.log(counts / counts.sum(1, keepdims=True))


@dataclass
class Forest:
    """Trees as arrays: at node i, feature[i] <= at[i] goes to child[i], else to child[i] + 1; a leaf has feature -1 and its share of secrets in at."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, least: int = 4, seed: int = 0) -> "Forest":
        rng, out = np.random.default_rng(seed), []
        some = max(1, int(math.sqrt(x.shape[1])) + 1)
        for _ in range(trees):
            drawn = rng.integers(0, len(x), len(x))
            feature, at, child = [-1], [0.0], [0]
            todo = [(0, drawn, 0)]
            while todo:
                node, rows, level = todo.pop()
                at[node] = float(y[rows].mean())
                if level == depth or len(rows) < 2 * least or at[node] in (0.0, 1.0):
                    continue
                best = (np.inf, -1, 0.0)
                for f in rng.permutation(x.shape[1])[:some]:
                    v = x[rows, f]
                    order = np.argsort(v, kind="stable")
                    v, ones = v[order], np.cumsum(y[rows][order])
                    k = np.arange(1, len(v))
                    left, right = ones[:-1] / k, (ones[-1] - ones[:-1]) / (len(v) - k)
                    impurity = k * left * (1 - left) + (len(v) - k) * right * (1 - right)
                    impurity[(v[1:] == v[:-1]) | (k < least) | (len(v) - k < least)] = np.inf
                    i = int(np.argmin(impurity))
                    if impurity[i] < best[0]:
                        best = (impurity[i], f, (v[i] + v[i + 1]) / 2)
                if best[1] < 0:
                    continue
                go = x[rows, best[1]] <= best[2]
                feature[node], at[node], child[node] = int(best[1]), best[2], len(feature)
                todo += [(len(feature), rows[go], level + 1), (len(feature) + 1, rows[~go], level + 1)]
                feature += [-1, -1]
                at += [0.0, 0.0]
                child += [0, 0]
            out.append((np.array(feature), np.array(at), np.array(child)))
        return cls(out)

    def probability(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, at, child in self.trees:
            node = np.zeros(len(x), int)
            while (inner := feature[node] >= 0).any():
                i = np.flatnonzero(inner)
                f = feature[node[i]]
                node[i] = child[node[i]] + (x[i, f] > at[node[i]])
            total += at[node]
        return total / max(1, len(self.trees))


def trained(n: int = LABELLED, seed: int = 0) -> tuple[Forest, np.ndarray]:
    transitions = letter_transitions()
    rows = labelled_findings(n, seed)
    x = np.array([features(t, a, b, transitions) for t, a, b, _ in rows])
    return Forest.fit(x, np.array([r[3] for r in rows])), transitions


def _found(texts: list[str], forest: Forest, transitions: np.ndarray) -> tuple[list[tuple[int, int, int]], np.ndarray]:
    found = [(i, a, b) for i, t in enumerate(texts) for a, b in spans(t)]
    if not found:
        return found, np.zeros(0)
    seen: dict[tuple[str, str, str], list[float]] = {}  # equal candidates with equal neighbours, by all that features read

    def read(text: str, a: int, b: int) -> list[float]:
        key = (text[max(0, a - 160) : a], text[a:b], text[b : b + 40])
        if key not in seen:
            seen[key] = features(text, a, b, transitions)
        return seen[key]

    return found, forest.probability(np.array([read(texts[i], a, b) for i, a, b in found]))


def from_raw_text(rows: list[tuple[str, int, int, int]], forest: Forest, transitions: np.ndarray, verdict: float = VERDICT) -> tuple[float, float]:
    """Of labelled findings, the share of secrets covered whole by what the scan of the raw texts calls secret, and of others touched."""
    covered = [np.zeros(len(t), bool) for t, *_ in rows]
    found, p = _found([t for t, *_ in rows], forest, transitions)
    for (i, a, b), q in zip(found, p):
        covered[i][a:b] |= q >= verdict
    whole = [(y, c[a:b].all(), c[a:b].any()) for (_, a, b, y), c in zip(rows, covered)]
    return float(np.mean([w for y, w, _ in whole if y])), float(np.mean([t for y, _, t in whole if not y]))


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", verdict: float = VERDICT) -> DataFrame:
    """`id, start, end, length, kind, value_sha256, probability, is_secret`: every candidate of every whole text.

    The forest (bounded: LABELLED made findings, TREES trees of DEPTH levels) goes to the tasks; each text is
    judged where it is read, with no shuffle. The value itself is not returned, only its digest. Null and
    empty texts have no candidates; repeated rows give their findings each; other columns are unused.
    """
    forest, transitions = trained()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].to_pylist()
            found, p = _found(texts, forest, transitions)
            values = [texts[i][a:b] for i, a, b in found]
            kinds = ["known" if KNOWN.match(v) else "hex" if re.fullmatch("[0-9a-fA-F]+", v) else "other" for v in values]
            cols = [batch["id"].take(pa.array([s[0] for s in found], pa.int64())), *(pa.array([s[k] for s in found], pa.int64()) for k in (1, 2)), pa.array([len(v) for v in values], pa.int64()), pa.array(kinds, pa.string()), pa.array([hashlib.sha256(v.encode("utf-8", "surrogatepass")).hexdigest() for v in values], pa.string()), pa.array(p), pa.array(p >= verdict)]
            yield pa.RecordBatch.from_arrays(cols, ["id", "start", "end", "length", "kind", "value_sha256", "probability", "is_secret"])

    return rows.mapInArrow(scan, f"id {dict(rows.dtypes)['id']}, start long, end long, length long, kind string, value_sha256 string, probability double, is_secret boolean")


def redacted(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", verdict: float = VERDICT) -> DataFrame:
    """All rows and columns of `docs` with every secret in the text replaced by `mark`; a null text stays null."""
    forest, transitions = trained()

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = batch[at].to_pylist()
            found, p = _found([t or "" for t in texts], forest, transitions)
            merged: list[list[int]] = []  # secrets that overlap are one
            for (i, a, b), q in zip(found, p):
                if q >= verdict and merged and merged[-1][0] == i and a < merged[-1][2]:
                    merged[-1][2] = max(merged[-1][2], b)
                elif q >= verdict:
                    merged.append([i, a, b])
            for i, a, b in reversed(merged):
                texts[i] = texts[i][:a] + mark + texts[i][b:]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, pa.string()))

    return docs.mapInArrow(clean, docs.schema)
