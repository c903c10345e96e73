"""Secret scans: candidates by shape, then a random forest that removes false positives.

Candidates are long unbroken runs of the characters that keys are written in, with or without an assignment before them;
of a run that is name=value, the value too; and from SHORT bytes on whatever is quoted or assigned beside a word for
secrets, of any characters. Candidates may overlap: the forest removes those that hold a name or are part of a value.
Features: length, how often neighbouring characters change class, shares of digits, capitals and hexadecimal digits,
distinct characters, coverage by dictionary words and by letter pairs usual in words, whether the run looks like a path
or an address, and which words stand beside it. The forest is trained on labelled findings, by Spark; the default set is
made by rule from a seed and states its own truth (labelled_findings), another table can be given.

Null and empty texts have no findings. Repeated rows are scanned each. Offsets are bytes of the whole text. Extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, texts_of

CANDIDATE = re.compile(rb"(?<![A-Za-z0-9+/_=.~-])[A-Za-z0-9+/_=.~-]{16,}(?![A-Za-z0-9+/_=.~-])")
ASSIGNED = re.compile(rb"([A-Za-z_][A-Za-z0-9_-]{0,40})[\"']?\s{0,3}(?:=|:|=>|:=)\s{0,3}[\"']?$")
#: Fewest bytes of a value that is quoted or assigned beside a word for secrets.
SHORT = 6
INNER = re.compile(rb"[A-Za-z_][A-Za-z0-9_.~-]*=(?=[^=])")
BESIDE = rb"(?i:token|secret|passw|pwd|api|key|auth|bearer|credential|private|access)[A-Za-z0-9_-]{0,64}+"
#: A name and an assignment, then a value up to white space or a quote; in an address up to & or # too.
PLAIN = re.compile(BESIDE + rb"[\"']?[ \t]{0,3}(?:=>|:=|=|:)[ \t]{0,3}(?=[^\s\"'`=][^\s\"'`]{%d})" % (SHORT - 1))
VALUE, IN_QUERY = re.compile(rb"[^\s\"'`]*"), re.compile(rb"[^\s\"'`&#]*")
#: A word, at most a few others or an assignment, then a quoted value.
QUOTED = re.compile(BESIDE + rb"[\"']?[^\"'`\n]{0,40}?(?<![A-Za-z0-9])(?P<quote>[\"'`])(?P<value>[^\"'`\n]{%d,}|(?:(?!(?P=quote))[^\n]){%d,})(?P=quote)(?![A-Za-z0-9])" % (SHORT, SHORT))
IN_ADDRESS = re.compile(rb"[?&][A-Za-z0-9_.-]*$")
# Words beside secrets, and beside what only looks like one.
SECRET_WORDS = frozenset("token secret password passwd pwd apikey api_key api key auth authorization bearer credential credentials private access access_key secret_key client_secret".split())
OTHER_WORDS = frozenset("sha sha1 sha256 md5 checksum digest hash commit revision etag uuid guid id version build example sample placeholder test dummy integrity".split())
#: Words that names and placeholders are made of.
DICTIONARY = frozenset("the and for with from this that your here key token secret password example sample test value name file path user users home data index config server client public static assets images image docs page http https www com org net html main module class function return string number default change placeholder insert replace enter dummy fake license version apache public general access account admin service library source build release update download content upload media report backup project".split())
USUAL_PAIRS = frozenset("th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur la el ta ns ge ec il pa us ie qu ei un sc".split())
FEATURES = ["length", "transitions", "digits", "capitals", "hexadecimal", "distinct", "words", "pairs", "separators", "path", "padding", "assigned", "secret_near", "other_near", "digits_only", "wide", "quoted", "holds_name", "part", "call"]


def spans(text: bytes) -> list[tuple[int, int]]:
    """Starts and ends of the candidates of a text, in order."""
    out = set()
    for m in CANDIDATE.finditer(text):
        out.add(m.span())
        name = INNER.match(m[0])
        if name and len(m[0]) - name.end() >= SHORT:
            out.add((m.start() + name.end(), m.end()))
    at = 0
    while m := PLAIN.search(text, at):
        a = m.end()
        # Only the value itself is read: an address with many parts is walked once.
        at = b = (IN_QUERY if IN_ADDRESS.search(text[max(0, m.start() - 60):m.start()]) else VALUE).match(text, a).end()
        b = a + len(text[a:b].rstrip(b",;)]}>."))
        name = INNER.match(text[a:b])
        out |= {(i, b) for i in (a, a + name.end() if name else a) if b - i >= SHORT}
    out |= {m.span("value") for m in QUOTED.finditer(text)}
    return sorted(out)


QUOTES = frozenset((b'"', b"'", b"`"))
#: Characters that join a candidate to more of the same value.
PARTS = frozenset(bytes([c]) for c in b"!@#$%^&*?|\\")


def features(text: bytes, a: int, b: int) -> list[float]:
    """Feature values of the candidate text[a:b]."""
    own = text[a:b].decode("latin-1")
    n = len(own)
    kind = [0 if "0" <= c <= "9" else 1 if "a" <= c <= "z" or c >= "\x80" else 2 if "A" <= c <= "Z" else 3 for c in own]
    low = own.lower()
    runs = re.findall(r"[a-z]+", low)
    words = sum(len(r) for r in runs if r in DICTIONARY) + sum(max((len(w) for w in DICTIONARY if len(w) > 3 and w in r), default=0) for r in runs if r not in DICTIONARY)
    letters = sum(len(r) for r in runs)
    pairs = sum(r[i:i + 2] in USUAL_PAIRS for r in runs for i in range(len(r) - 1))
    before, after = text[max(0, a - 60):a], text[b:b + 40]
    named = ASSIGNED.search(before)
    near = [w.decode("ascii", "ignore").lower() for w in re.findall(rb"[A-Za-z0-9_]+", before)[-3:] + re.findall(rb"[A-Za-z0-9_]+", after)[:1]]
    if named:
        near.append(named[1].decode("ascii", "ignore").lower())
    parts = {p for w in near for p in (w, *w.split("_"))}
    return [float(x) for x in (
        n, sum(x != y for x, y in zip(kind, kind[1:], strict=False)) / n, kind.count(0) / n, kind.count(2) / n, sum(c in "0123456789abcdef" for c in low) / n,
        len(set(own)) / min(n, 64), words / n, pairs / max(1, letters - len(runs)) if letters > 1 else 0.0, kind.count(3) / n,
        ("/" in own) * own.count("/") / n * 10 + (own.count(".") > 1), own.endswith("="), bool(named), bool(parts & SECRET_WORDS), bool(parts & OTHER_WORDS), kind.count(0) == n,
        len(re.findall(r"[^A-Za-z0-9+/_=.~\x80-\xff-]", own)) / n, text[max(0, a - 1):a] in QUOTES and text[b:b + 1] == text[a - 1:a], bool(INNER.match(text[a:b])),
        text[max(0, a - 1):a] in PARTS or text[b:b + 1] in PARTS - {b"?", b"!", b"&", b"#"} or text[b:b + 1] in (b"!", b"&", b"#") and text[b + 1:b + 2].isalnum() and not IN_ADDRESS.search(before.rsplit(b"=", 1)[0]), own.endswith(("(", "[", "{")) or own[0] in "<${%(")]


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, start, end, sha256 (of the candidate) and features of every candidate in docs(doc_id, text, ...)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = texts_of(batch)
            raw, key = memoryview(np.ascontiguousarray(data)), batch.column("doc_id")
            rows: list[tuple] = []
            for d, (i, j) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
                text = bytes(raw[i:j])
                rows += [(d, a, b, hashlib.sha256(text[a:b]).hexdigest(), features(text, a, b)) for a, b in spans(text)]
            d, a, b, sha, x = zip(*rows, strict=True) if rows else ([],) * 5
            x = np.array(x, float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([key.take(pa.array(d, pa.int64())), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sha, pa.string()), *(pa.array(c) for c in x.T)], ["doc_id", "start", "end", "sha256", *FEATURES])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, start long, end long, sha256 string, " + ", ".join(f"{f} double" for f in FEATURES))


def labelled_findings(n: int = 6000, seed: int = 5) -> pd.DataFrame:
    """text, label (1: a secret) of n findings made by rule: keys of several alphabets, and look-alikes of several kinds."""
    rng = random.Random(seed)
    pick = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    lower, upper, digit, hexa = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
    syllables = "th he in er an re on ti es or ed ha ou le st nt ing tion ment eau que ung sch heit cion ado".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    words = lambda k: " ".join(word() for _ in range(k))
    names, others, plain = sorted(SECRET_WORDS), sorted(OTHER_WORDS), sorted(DICTIONARY)
    password = lambda: rng.choice([lambda: rng.choice([word(), word().capitalize()])[:10] + pick(digit, rng.randint(2, 4)) + pick("!@#$%&*?", rng.randint(0, 2)), lambda: pick(lower + upper + digit + "!@#$%^&*?-_.", rng.randint(8, 20)), lambda: pick(lower + upper + digit, rng.randint(8, 15)),
                                   lambda: rng.choice("PSTL") + pick("@0$13", 1) + word()[:6] + pick("!#$%&*", 1) + pick(digit, rng.randint(2, 4)) + pick("!#", 1) + pick(lower, rng.randint(0, 2))])().ljust(SHORT, "7")
    rows = []
    for k in range(n // 2):
        if k % 3 == 0:
            key, name, quote = password(), rng.choice(names), rng.choice(['"', "'", ""])
            name = rng.choice([name, name.upper(), "db_" + name, "MY_" + name.upper()])
            quote = quote or ("" if key.rstrip(",;)]}>.") == key else '"')
            beside = rng.choice([" = ", "=", ": "] + ([" is ", " "] if quote else []))
            before = f"{words(4)} {name}{beside}{quote}"
            rows.append((f"{before}{key}{quote} {words(4)}", key, 1, len(before)))
            continue
        key = rng.choice([lambda: pick(hexa, rng.choice([32, 40, 48, 64])), lambda: pick(lower + upper + digit, rng.randint(20, 64)), lambda: pick(lower + upper + digit + "+/", rng.randint(24, 64)) + "=" * rng.randint(0, 2),
                          lambda: "AKIA" + pick(upper + digit, 16), lambda: rng.choice(["ghp_", "sk-", "xoxb-", "glpat-"]) + pick(lower + upper + digit, 36)])()
        if rng.random() < 0.2:
            key = key.upper()
        name, quote = rng.choice(names), rng.choice(['"', "'", ""])
        name = name.upper() if rng.random() < 0.3 else name
        at = rng.choice(["", "", "https://example.com/x?", "export "]) if not quote else ""
        before = f"{words(4)} {at}{name}{'=' if at else rng.choice([' = ', '=', ': ', ' '])}{quote}"
        rows.append((f"{before}{key}{quote} {words(4)}", key, 1, len(before)))
    for k in range(n - n // 2):
        if k % 3 == 0:
            # What lies beside a secret's name and is none: words, placeholders, calls; a name with its value; a part of a value.
            name, quote = rng.choice(names), rng.choice(['"', "'", ""])
            kind = rng.randrange(8)
            own = [lambda: rng.choice([word() + word() + word(), rng.choice(plain) + rng.choice(plain)]).ljust(SHORT, "e"), lambda: rng.choice(plain) + rng.choice("._-") + rng.choice(plain) + "e", lambda: rng.choice("<${%") + rng.choice(["your", "my", "insert"]) + rng.choice("-_ ") + name + ">", lambda: rng.choice("*x.") * rng.randint(6, 14),
                   lambda: rng.choice(["os.getenv(", "get_" + name + "(", "config[", "input()", "None,null", "https://www.example.com/" + word()]), lambda: words(rng.randint(3, 9)).ljust(SHORT, "e"), lambda: name.upper() + "=" + pick(lower + upper + digit, rng.randint(16, 40)), lambda: pick(lower + upper + digit, rng.randint(16, 24))][kind]()
            if kind == 6:
                before, after = words(4) + " ", " "
            elif kind == 7:
                before, after = rng.choice([(f"{words(4)} {name}{rng.choice(['=', ': '])}{pick(lower + upper, 3)}{pick('!@#$%&*', 1)}", " "), (f"{words(4)} {name}{rng.choice(['=', ': '])}", pick("@$%*", 1) + pick(lower, 4) + " ")])
            else:
                quote = quote or ('"' if " " in own else "")
                before, after = f"{words(4)} {name}{rng.choice([' = ', '=', ': ', ' is ', ' ', ' word ']) if quote else rng.choice([' = ', '=', ': '])}{quote}", quote + " "
            rows.append((f"{before}{own}{after}{words(4)}", own, 0, len(before)))
            continue
        kind = rng.randrange(9)
        own = [lambda: pick(digit, rng.randint(16, 20)), lambda: "".join(word() for _ in range(8))[:rng.randint(16, 40)].ljust(16, "e"), lambda: "/".join(rng.choice(plain) for _ in range(5)) + "/" + word() + ".html", lambda: "-".join(rng.choice(plain) for _ in range(5)),
               lambda: "YOUR_" + "_".join(rng.choice(plain).upper() for _ in range(3)) + "_HERE", lambda: rng.choice("xy0.-=_a") * rng.randint(16, 40), lambda: pick(hexa, 8) + "-" + "-".join(pick(hexa, 4) for _ in range(3)) + "-" + pick(hexa, 12),
               lambda: pick(hexa, rng.choice([32, 40, 64])), lambda: ".".join([word(), word(), rng.choice(plain), "example.com"]).ljust(16, "m")][kind]()
        before = rng.choice(others) + rng.choice([" ", ": ", " = "]) if kind in (6, 7) else rng.choice(["", "", rng.choice(names) + rng.choice([" = ", ": "])]) if kind in (4, 5) else ""
        before = f"{words(4)} {before}"
        rows.append((f"{before}{own} {words(4)}", own, 0, len(before)))
    return pd.DataFrame([(t, a, a + len(k), y) for t, k, y, a in rows], columns=["text", "start", "end", "label"])


def train(spark: SparkSession, findings: pd.DataFrame | None = None, trees: int = 40, depth: int = 8, most_rows: int = 20_000) -> RandomForestClassificationModel:
    """A forest from at most `most_rows` labelled findings (text, start, end, label)."""
    findings = (labelled_findings() if findings is None else findings).head(most_rows)
    rows = [(float(y), *features(t.encode(), a, b)) for t, a, b, y in findings[["text", "start", "end", "label"]].itertuples(index=False)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["label", *FEATURES]))
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=3).fit(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(df))


def scan(docs: DataFrame, model: RandomForestClassificationModel, least: float = 0.5) -> DataFrame:
    """doc_id, start, end, sha256, probability, is_secret of every candidate."""
    x = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(candidates(docs))
    p = vector_to_array("probability")[1]
    return model.transform(x).select("doc_id", "start", "end", "sha256", p.alias("probability"), (p >= least).alias("is_secret"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"), train(spark))
