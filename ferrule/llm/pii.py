"""Surrogates for personal data.

Entities are found in the whole text: e-mail addresses, IPv4 addresses, payment cards, telephone numbers, social security
numbers, IBANs, secrets (values assigned to a key, token or password, and well-known token forms) and names (after a title,
or a known given name, all capitalised words and initials that follow, and their parts, initials aside, wherever the text repeats
them). An assigned secret runs to its closing quote or to white space. Each is replaced by one of its own
kind, derived from a secret key: digits for digits and letters for letters in the same format and case, a valid check digit
where there was one, a given name of the same gender and script, a surname of the same script. An entity is the same in all
its spellings, so it has one surrogate in all documents, whatever the titles before a name: a given name that isn't in the list has the gender that most
of its titles in the corpus say. A domain is an entity of its own, and all addresses of a domain share its surrogate.

All distinct entities of the corpus are checked: where two would share a surrogate, or one would be given what is another's
real value (initials aside: there are too few letters), all but the first get the surrogate of a further attempt, until none collide. Only those exceptions travel to the
documents: as a broadcast table up to ``most_shipped`` of them, by a join beyond.

The key has no default: whoever has it can work out what stands for a value.

Defined results: a null text stays null; empty texts and texts without entities stay as they are; where findings overlap the
one that starts first counts, then the kind listed first; rows are never dropped or merged, whatever their ids; other columns
are kept, whatever their names; very long texts take time in proportion to their length; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrule.llm._shared import bounded, free, released, stored

GIVEN = {
    "m:latin": "James John Robert Michael William David George Henry Paul Peter Thomas Samuel Frank Jack Noah Liam Lucas Oliver Hans Pierre Carlos Miguel Juan Klaus",
    "f:latin": "Mary Alice Carol Emma Julia Karen Laura Maria Rachel Sarah Sofia Susan Olivia Isabella Natalia Jane Anna Claire Elena Greta Lucia Ingrid Marie Carmen",
    "m:cyrillic": "Иван Алексей Дмитрий Сергей Николай Павел Андрей Михаил Виктор Олег",
    "f:cyrillic": "Анна Елена Мария Ольга Наталья Татьяна Ирина Светлана Вера Людмила",
    "m:greek": "Γιώργος Νίκος Δημήτρης Κώστας Παναγιώτης Βασίλης Θανάσης Μιχάλης",
    "f:greek": "Μαρία Ελένη Κατερίνα Σοφία Αγγελική Βασιλική Δήμητρα Ιωάννα",
    "u:latin": "Alex Robin Kim Sam Jordan Taylor Casey Morgan Jamie Riley",
    "u:cyrillic": "Саша Женя Валя Слава",
    "u:greek": "Χρύσα Άρης Φώτης Αλεξία",
}
SYLLABLES = {"latin": "ba be bo ca da de di do fa ga go ha ka la le li lo ma me mi mo na ne no pa ra re ri ro sa se so ta te to va ve vi wa za".split(), "cyrillic": "ба ве го да ка ла ле ли ло ма ме ми на не но па ра ре ро са се со та те то ва ви за".split(), "greek": "βα γε δα κα λα λε λι μα με μι να νε νο πα ρα ρε σα σε τα τε το".split()}
TITLES = {t: g for g, own in (("m", "Mr Herr Monsieur Señor Sr господин г-н Κύριος"), ("f", "Mrs Ms Miss Mme Mlle Madame Frau Señora Sra госпожа г-жа Κυρία"), ("u", "Dr Prof")) for t in own.split()}

_WORD = r"[^\W\d_]+(?:['’-][^\W\d_]+)*"
_TITLED = re.compile(rf"\b({'|'.join(sorted(map(re.escape, TITLES), key=len, reverse=True))})(?:\. ?| )(?=[^\W\d_])")
_WHOLE = re.compile(rf"(?<!\w){_WORD}(?!\w)")
_PIECE = re.compile(rf"([^\W\d_])\.|({_WORD})")  # an initial or a word
_OF = {n: k for k, own in GIVEN.items() for n in own.split()}
_NAMED = re.compile(rf"(?<![^\W_])({'|'.join(sorted(_OF, key=len, reverse=True))})(?= [^\W\d_])")
_ASSIGNED = re.compile(r"""[:=][ \t]*(?:Bearer )?(?:"([^"\n]+)"|'([^'\n]+)'|“([^”\n]+)”|["'“]?(\S+))""")
_PASSWORD = re.compile(r"(?:passw(?:or)?d|pwd)[\"' \t]*$", re.I)
_NAME_OF_SECRET = re.compile(r"(?:api[_ -]?key|access[_ -]?key|secret|token|passw(?:or)?d|pwd|key)[\"' \t]*$", re.I)
_TOKEN = re.compile(r"(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|sk-[A-Za-z0-9]{20,})(?![A-Za-z0-9])")
_LOCAL = re.compile(r"[\w.+%\-]{1,64}\Z")
_DOMAIN = re.compile(r"(?:[^\W_](?:[\w\-]{0,61}[^\W_])?\.)+[^\W\d_]{2,24}")
_DIGIT = re.compile(r"[0-9]")
_RUN = re.compile(r"[+(]?[0-9][0-9+() .\-]{5,}")
_NUMBER = re.compile(
    r"(?<![0-9A-Za-z_])(?:(?P<ip>(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9]))"
    r"|(?P<ssn>[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-]))"
    r"|(?P<phone>\+1[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])|\+(?!1)[0-9]{1,3}[ .-]?\(?[0-9]{1,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])|[0-9]{3}([.-])[0-9]{3}\4[0-9]{4}(?![0-9-]))"
    r"|(?P<card>[0-9]{4}([ -])[0-9]{4}\6[0-9]{4}\6[0-9]{1,7}(?![0-9])|[0-9]{13,19}(?![0-9])))"
)
_LETTERS = re.compile(r"[^\W\d_]+")
_IBAN = re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])")


def script(word: str) -> str:
    c = word[:1]
    return "cyrillic" if "Ѐ" <= c <= "ӿ" else "greek" if "Ͱ" <= c <= "Ͽ" or "ἀ" <= c <= "῿" else "latin"


def _family(word: str) -> str:
    """The kind of a surname: its gender shows in its ending or not at all, so that it's one entity after any title."""
    of, end = script(word), word[-1:].lower()
    return f"family:{'u' if of == 'latin' else 'f' if end in ('а', 'я') or of == 'greek' and end != 'ς' else 'm'}:{of}"


def _luhn(digits: str) -> bool:
    own = [int(c) for c in digits[::-1]]
    return (sum(own[::2]) + sum(sum(divmod(2 * x, 10)) for x in own[1::2])) % 10 == 0


def _names(text: str) -> Iterator[tuple[int, int, str]]:
    parts: dict[str, str] = {}

    def part(word: str, kind: str) -> str:
        return parts.setdefault(word, kind)

    def run(at: int) -> list[re.Match]:
        """The capitalised words and initials from a place on."""
        own: list[re.Match] = []
        while (m := _PIECE.match(text, at)) and m[0][:1].isupper():
            own.append(m)
            at = m.end() + (text[m.end() : m.end() + 1] == " ")
            if at == m.end() and not m[1]:
                break
        return own

    def name(own: list[re.Match], gender: str) -> Iterator[tuple[int, int, str]]:
        for i, m in enumerate(own):
            if len(own) > 1 and (m[1] or len(m[2]) == 1):
                yield m.start(), m.start() + 1, "initial"
            else:
                w = m[1] or m[2]
                kind = "given:" + (_OF.get(w) or f"{gender}:{script(w)}") if i < len(own) - 1 else _family(w)
                yield m.start(), m.start() + len(w), part(w, kind)

    for m in _TITLED.finditer(text):
        yield from name(run(m.end()), TITLES[m[1]])
    end = 0
    for m in _NAMED.finditer(text):
        if m.start() >= end and len(own := run(m.start())) > 1:
            end = own[-1].end()
            yield from name(own, _OF[m[1]][0])
    if parts:
        for m in _WHOLE.finditer(text):
            if m[0] in parts:
                yield m.start(), m.end(), parts[m[0]]
            elif len(m[0]) > 1 and not m[0].isalpha():  # a name within hyphens or before an apostrophe
                for x in _LETTERS.finditer(m[0]):
                    if x[0] in parts:
                        yield m.start() + x.start(), m.start() + x.end(), parts[x[0]]


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) of each entity in the order of the text; the value is one for all spellings."""
    found: list[tuple[int, int, int, str, str]] = []
    if "=" in text or ":" in text:
        for m in _ASSIGNED.finditer(text):
            if not _NAME_OF_SECRET.search(text, max(0, m.start() - 24), m.start()):
                continue
            value = m[m.lastindex] if m.lastindex < 4 else m[4].rstrip(",.;:)]}>\"'”")
            solid = sum(c.isalpha() or "0" <= c <= "9" for c in value)
            if solid >= 4 and _PASSWORD.search(text, max(0, m.start() - 24), m.start()) or solid >= 8 and (_DIGIT.search(value) or solid >= 16 and " " not in value):
                found.append((m.start(m.lastindex), 0, m.start(m.lastindex) + len(value), "secret", value))
    if "AKIA" in text or "gh" in text or "sk-" in text:
        found += [(m.start(), 0, m.end(), "secret", m[0]) for m in _TOKEN.finditer(text)]
    i = text.find("@")
    while i >= 0:
        a, b = _LOCAL.search(text, max(0, i - 64), i), _DOMAIN.match(text, i + 1)
        if a and b and (local := a[0].lstrip(".")):
            found.append((i - len(local), 1, b.end(), "email", text[i - len(local) : b.end()].lower()))
        i = text.find("@", i + 1)
    if _DIGIT.search(text):
        for run in _RUN.finditer(text):
            for m in _NUMBER.finditer(text, run.start(), run.end()):
                kind = m.lastgroup if m.lastgroup in ("ip", "ssn", "phone", "card") else next(k for k in ("ip", "ssn", "phone", "card") if m[k])
                digits = re.sub(r"[^0-9]", "", m[0])
                if text[m.end() : m.end() + 1].isalpha() or kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "phone" and not 8 <= len(digits) <= 15:
                    continue
                value = m[0] if kind == "ip" else ("+" if m[0][0] == "+" else "") + digits
                found.append((m.start(), 3, m.end(), kind, value))
        found += [(m.start(), 2, m.end(), "iban", m[0].replace(" ", "")) for m in _IBAN.finditer(text) if 15 <= len(m[0].replace(" ", "")) <= 34]
    found += [(a, 4, b, kind, text[a:b].lower()) for a, b, kind in _names(text)]
    found.sort()
    out: list[tuple[int, int, str, str]] = []
    for a, _, b, kind, value in found:
        if not out or a >= out[-1][1]:
            out.append((a, b, kind, value))
    return out


class _Stream:
    """Numbers derived from the key, a kind, a value and an attempt."""

    def __init__(self, key: bytes, *what: object) -> None:
        self.key, self.what, self.held, self.n = hashlib.blake2b(key, digest_size=32).digest(), "\x00".join(map(str, what)).encode(), 0, 0
        self.block = 0

    def below(self, most: int) -> int:
        if self.n < 1 << 64:
            self.held = int.from_bytes(hashlib.blake2b(self.what + self.block.to_bytes(4, "big"), key=self.key, digest_size=64).digest(), "big")
            self.n, self.block = 1 << 512, self.block + 1
        self.held, got = divmod(self.held, most)
        self.n //= most
        return got


def _letters(value: str, s: _Stream, hexadecimal: bool = False) -> str:
    def one(c: str) -> str:
        if "0" <= c <= "9":
            return "0123456789"[s.below(10)]
        own = "abcdef" if hexadecimal else SYLLABLES_LETTERS[script(c)]
        return (own.upper() if c.isupper() else own)[s.below(len(own))] if c.isalpha() else c

    return "".join(map(one, value))


SYLLABLES_LETTERS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзиклмнопрстуфхцчш", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}


def surrogate(key: bytes, kind: str, value: str, attempt: int, domain_attempt: int = 0) -> str:
    """What stands for a value, in the same normal form; after some attempts longer, where there may be too few of a length."""
    s = _Stream(key, kind, value, attempt)
    more = "" if attempt < 4 else "".join(SYLLABLES["latin"][s.below(40)] for _ in range(attempt // 4))
    if kind == "email":
        local, _, domain = value.partition("@")
        return f"{_letters(local, s)}{more}@{surrogate(key, 'domain', domain, domain_attempt)}"
    if kind == "domain":
        names, _, top = value.rpartition(".")
        return f"{_letters(names, s)}{more}.{top}"
    if kind == "ip":
        own = value.split(".")
        keep = 1 if own[0] in ("10", "127") else 2 if own[:2] == ["192", "168"] else 0
        return ".".join(own[:keep] + [str(1 + s.below(254)) for _ in own[keep:]])
    if kind == "phone":
        keep = 0 if value[0] != "+" else 2 if value[1] == "1" else 3
        return value[:keep] + "".join(str(s.below(10)) for _ in value[keep:])
    if kind == "card":
        body = value[0] + "".join(str(s.below(10)) for _ in value[1:])
        return next(body[:-1] + c for c in "0123456789" if _luhn(body[:-1] + c)) if _luhn(value) else body
    if kind == "iban":
        body = _letters(value[4:], s)
        return f"{value[:2]}{98 - int(''.join(str(int(c, 36)) for c in body + value[:2] + '00')) % 97:02d}{body}"
    if kind == "initial":
        own = SYLLABLES_LETTERS[script(value)].replace(value, "")
        return own[s.below(len(own))]
    if kind.startswith("given"):
        own = GIVEN[kind[6:]].split()
        tail = "" if attempt < 4 else "".join(SYLLABLES[kind.rpartition(":")[2]][s.below(20)] for _ in range(1 + attempt // 4))  # the list is short: longer names after a few attempts
        return (own[s.below(len(own))] + tail).lower()
    if kind.startswith("family"):
        _, gender, of = kind.split(":")
        own = SYLLABLES[of]
        ending = {"cyrillic": "ова" if gender == "f" else "ов", "greek": "ου" if gender == "f" else "ης"}.get(of, "")
        return "".join(own[s.below(len(own))] for _ in range(4 + attempt // 4)) + ending
    return _letters(value, s, bool(re.fullmatch(r"[0-9a-fA-F]+", value)))


def _dressed(surface: str, kind: str, new: str) -> str:
    """A surrogate in the spelling of what it replaces."""
    if kind in ("phone", "card", "ssn", "iban"):
        own = iter(new.lstrip("+"))
        return "".join(next(own, "") if c.isalnum() else c for c in surface)
    if kind == "email":
        return "".join(b.upper() if a.isupper() else b for a, b in zip(surface, new)) if len(surface) == len(new) else new
    if kind[:5] in ("given", "famil", "initi"):
        return new.upper() if surface.isupper() and len(surface) > 1 else new[:1].upper() + new[1:]
    return new


Attempts = dict[tuple[str, str], tuple[str, int]]


def replaced(text: str, key: bytes, attempts: Attempts) -> tuple[str, int]:
    """The text with surrogates, and how many; attempts: of some (kind, value) the kind they are taken for and the attempt."""
    own = entities(text)
    out, at = [], 0
    for a, b, kind, value in own:
        taken, n = attempts.get((kind, value), (kind, 0))
        domain = attempts.get(("domain", value.partition("@")[2]), ("", 0))[1] if kind == "email" else 0
        out += [text[at:a], _dressed(text[a:b], kind, surrogate(key, taken, value, n, domain))]
        at = b
    return ("".join(out) + text[at:], len(own)) if own else (text, 0)


def keys_of(own: list[tuple[int, int, str, str]]) -> Iterator[tuple[str, str]]:
    """Each entity found, and the domain of each address."""
    for *_, kind, value in own:
        yield kind, value
        if kind == "email":
            yield "domain", value.partition("@")[2]


def attempts_needed(found: DataFrame, key: bytes, most_rounds: int = 40) -> DataFrame:
    """(kind, value, attempt) of those entities of found(kind, value, domain_attempt), distinct, that the first attempt doesn't suit."""
    family = F.regexp_extract("kind", "^[a-z]+", 0)  # names are apart from each other whatever their gender and script
    columns = ("kind", "value", "domain_attempt", "attempt")

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = [surrogate(key, k, v, n, d) for k, v, d, n in zip(*(b.column(c).to_pylist() for c in columns))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(new, pa.string())], [*columns, "new"])

    schema = "kind string, value string, domain_attempt int, attempt int, new string"
    real = found.select(family.alias("family"), F.col("value").alias("new"), F.lit(True).alias("real")).distinct()
    now = stored(found.select(*columns[:3], F.lit(0).alias("attempt")).mapInArrow(propose, schema), "surrogates")
    by = Window.partitionBy("family", "new").orderBy("attempt", "kind", "value")
    for _ in range(most_rounds):
        judged = now.withColumn("family", family).withColumn("k", F.row_number().over(by)).join(real, ["family", "new"], "left")
        judged = stored(judged.select(*columns, "new", ((F.col("k") > 1) | F.col("real").isNotNull()).alias("clash")), "judged")
        again = judged.where("clash")
        if again.isEmpty():
            free(judged)
            return now.where("attempt > 0").select("kind", "value", "attempt")
        fresh = again.select(*columns[:3], (F.col("attempt") + 1).cast("int").alias("attempt")).mapInArrow(propose, schema)
        after = stored(judged.where("not clash").drop("clash").unionByName(fresh), "surrogates")
        free(now, judged)
        now = after
    raise RuntimeError("surrogates still collide")


def exceptions(seen: DataFrame, key: bytes) -> DataFrame:
    """(kind, value, taken, attempt) of those entities of seen(kind, value, n), counted over the corpus, that aren't taken for
    the kind they were found as or need another attempt."""
    given = F.col("kind").startswith("given:")
    known = ~given | F.col("kind").startswith("given:u:")
    votes = F.struct((~known).alias("says"), F.col("n"), F.col("kind"))
    kinds = seen.where(given).groupBy("value").agg(F.max_by("kind", votes).alias("taken"))
    found = stored(seen.join(kinds, "value", "left").select("kind", "value", F.coalesce(F.when(given, F.col("taken")), F.col("kind")).alias("taken")), "taken")
    own = found.select(F.col("taken").alias("kind"), "value").distinct().where("kind <> 'initial'").withColumn("domain_attempt", F.lit(0))
    domains = stored(attempts_needed(own.where("kind = 'domain'"), key), "domains")
    rest = own.where("kind <> 'domain'").drop("domain_attempt").withColumn("domain", F.when(F.col("kind") == "email", F.substring_index("value", "@", -1)))
    rest = rest.join(domains.select(F.col("value").alias("domain"), F.col("attempt").alias("domain_attempt")), "domain", "left")
    others = attempts_needed(stored(rest.select("kind", "value", F.coalesce("domain_attempt", F.lit(0)).alias("domain_attempt")), "named"), key)
    need = domains.unionByName(others).withColumnRenamed("kind", "taken")
    out = found.join(need, ["taken", "value"], "left").where("attempt is not null or taken <> kind")
    return out.select("kind", "value", "taken", F.coalesce("attempt", F.lit(0)).alias("attempt"))


def surrogates(docs: DataFrame, key: bytes, *, text: str = "text", count: str | None = None, most_shipped: int = 1_000_000) -> DataFrame:
    """``docs`` with the entities of its texts replaced; with ``count``, how many, in a column of that name."""
    texts = bounded(docs).select(F.col(f"`{text}`").cast("string").alias("text")).where("text is not null")
    own_name, row_name = (name + "_" * sum(c.startswith(name) for c in docs.columns) * 40 for name in ("__own", "__row"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = sorted(Counter(x for t in b.column("text").to_pylist() for x in set(keys_of(entities(t)))).items())
            yield pa.RecordBatch.from_arrays([pa.array([x[0][0] for x in own], pa.string()), pa.array([x[0][1] for x in own], pa.string()), pa.array([x[1] for x in own], pa.int64())], ["kind", "value", "n"])

    found = stored(texts.mapInArrow(released(find), "kind string, value string, n long").groupBy("kind", "value").agg(F.sum("n").alias("n")), "entities")
    need = stored(exceptions(found, key), "exceptions")
    kept = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c != count))
    tables = None
    if need.count() <= most_shipped:
        tables = docs.sparkSession.sparkContext.broadcast({(r["kind"], r["value"]): (r["taken"], r["attempt"]) for r in need.collect()})
        rows = kept.withColumn(own_name, F.lit(None).cast("array<struct<kind:string,value:string,taken:string,attempt:int>>"))
    else:  # each text with the exceptions among its own entities
        ided = stored(kept.withColumn(row_name, F.monotonically_increasing_id()), "rows")

        def of_row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                own = [(r, k, v) for r, t in zip(b.column("row").to_pylist(), b.column("text").to_pylist()) for k, v in sorted(set(keys_of(entities(t or ""))))]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in own], t) for i, t in ((0, pa.int64()), (1, pa.string()), (2, pa.string()))], ["row", "kind", "value"])

        each = ided.select(F.col(row_name).alias("row"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(of_row, "row long, kind string, value string")
        lists = each.join(need, ["kind", "value"]).groupBy(F.col("row").alias(row_name)).agg(F.collect_list(F.struct("kind", "value", "taken", "attempt")).alias(own_name))
        rows = ided.join(lists, row_name, "left").drop(row_name)

    fields = [f if f.name != text else T.StructField(f.name, T.StringType()) for f in kept.schema.fields]
    names = [f.name for f in fields]
    schema = T.StructType(fields + ([T.StructField(count, T.IntegerType())] if count else []))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(own_name).to_pylist() if tables is None else [None] * b.num_rows
            got = [
                (None, 0) if t is None else replaced(t, key, tables.value if tables is not None else {(x["kind"], x["value"]): (x["taken"], x["attempt"]) for x in (n or ())})
                for t, n in zip(b.column(text).cast(pa.string()).to_pylist(), own)
            ]
            new = pa.array([t for t, _ in got], pa.string())
            columns = [new if c == text else b.column(c) for c in names]
            if count:
                columns.append(pa.array([n for _, n in got], pa.int32()))
            yield pa.RecordBatch.from_arrays(columns, names + ([count] if count else []))

    return rows.mapInArrow(released(apply), schema)
