"""Texts decoded with a wrong encoding: finding them, and giving back the original where nothing was lost.

Method: a multinomial classifier on hashed byte bigrams. Its unit is a run: a maximal stretch of characters beyond ASCII
with one neighbour on either side. Training takes the runs of about SAMPLE_ROWS records (chosen by a hash of the key),
garbles them by every chain of CHAINS, and counts the bigrams of their UTF-8 bytes per chain and for the runs as they are
('clean'), where the records are; only the counts come to the driver. As a few of the sampled texts are garbled themselves,
the runs found garbled are left out and the counts made again. A run is predicted the likeliest chain that can be inverted: for chains from UTF-8 the bytes must hold well-formed
sequences of several bytes, for others they must decode strictly, and what comes out must be likelier clean text than what
went in, both in lower case. U+FFFD is what a failed decoding leaves; a run that holds it is garbled and is not restored.

An inversion from UTF-8 is taken as proof if each character it gives is one that clean text has, or if it takes the whole run
and gives PROOF characters beyond ASCII. Clean text is that of all records, not of the sample: a first pass keeps the texts
with a run that could be inverted and gathers the characters of all other texts, a second judges the kept texts by them.

All texts are judged whole; only those with a character beyond ASCII can be affected. A worker judges each distinct run
once. The model has a fixed size (classes × BUCKETS numbers, and at most all characters of Unicode) and is broadcast.

Null, empty and ASCII texts give no row. Repeated rows are reported as often as they come. A table without any sampled run
gives no row.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findery.sources.scratch import materialize

#: About so many records, none of more characters, are sampled for training.
SAMPLE_ROWS, SAMPLE_CHARACTERS = 5000, 100_000
BUCKETS = 1 << 14
#: Log odds against 'clean' that a run must reach, for chains from UTF-8 and for others.
ENOUGH, ENOUGH_IF_WEAK = 0.0, 3.0
CLEAN_PRIOR = 0.97
#: Share of the characters of a run, or of a stretch of it between wide ones, that must take part in an inversion.
COVERED = 0.5
#: Share of probability for unseen buckets, the same for every class.
UNSEEN = 0.01
#: Chains that don't start from UTF-8 need so many different runs of so many different characters in a text, or longer ones.
LONG, LONG_RUNS = 4, 2
#: Restored characters beyond ASCII that prove a whole inversion, whatever characters they are.
PROOF = 4
#: Dashes, quotes and signs that text of any kind may have, be they in the records or not.
TYPOGRAPHIC = frozenset(map(chr, (*range(0x2010, 0x2028), *range(0x2030, 0x203B), 0x20AC, 0x2122)))
LOST = "\ufffd"

# Chains of (encoded as, decoded as), first step first. 'utf-8' as the second is decoding with replacement.
CHAINS: tuple[tuple[tuple[str, str], ...], ...] = (
    (("utf-8", "cp1252"),),
    (("utf-8", "latin-1"),),
    (("utf-8", "cp1250"),),
    (("utf-8", "iso8859-2"),),
    (("utf-8", "iso8859-15"),),
    (("utf-8", "mac_roman"),),
    (("utf-8", "cp437"),),
    (("utf-8", "cp850"),),
    (("utf-8", "cp1251"),),
    (("utf-8", "cp866"),),
    (("utf-8", "gbk"),),
    (("utf-8", "cp1252"), ("utf-8", "cp1252")),
    (("utf-8", "latin-1"), ("utf-8", "latin-1")),
    (("utf-8", "cp1252"), ("utf-8", "latin-1")),
    (("utf-8", "cp1252"), ("utf-8", "cp1252"), ("utf-8", "cp1252")),
    (("gbk", "latin-1"),),
    (("gbk", "cp1252"),),
    (("cp1251", "latin-1"),),
    (("cp1251", "cp1252"),),
    (("koi8-r", "cp1251"),),
    (("cp1251", "koi8-r"),),
    (("koi8-r", "latin-1"),),
    (("cp1252", "utf-8"),),
    (("cp1251", "utf-8"),),
    (("gbk", "utf-8"),),
)

_RUN = re.compile(r"[\x00-\x7f]?[^\x00-\x7f]+[\x00-\x7f]?")
#: What a single-byte page cannot hold, in text that needs no spaces: such text can surround a garbled stretch.
_WIDE = "\u2e80-\ua4cf\uac00-\ud7a3\uf900-\ufaff\uff00-\uffef\U00020000-\U0003ffff"
_STRETCH = re.compile(f"[^\x00-\x7f{_WIDE}]{{2,}}")
_HAS_WIDE = re.compile(f"[{_WIDE}]")
_WELL_FORMED = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}")


def name(chain: tuple[tuple[str, str], ...]) -> str:
    return " ".join(f"{a}>{b}" for a, b in chain)


def _to_bytes(text: str, encoding: str) -> bytes | None:
    """The bytes that were decoded to ``text``; single-byte pages pass the control characters they leave undefined."""
    try:
        return text.encode(encoding)
    except UnicodeEncodeError:
        if encoding not in ("cp1252", "cp1250", "cp1251"):
            return None
        out = bytearray()
        for c in text:
            try:
                out += c.encode(encoding)
            except UnicodeEncodeError:
                if not 0x80 <= ord(c) <= 0x9F:
                    return None
                out.append(ord(c))
        return bytes(out)


#: Undefined bytes, as 'surrogateescape' marks them.
_UNDEFINED = re.compile("[\udc80-\udcff]")


def _from_bytes(data: bytes, encoding: str) -> str:
    if encoding in ("cp1252", "cp1250", "cp1251"):
        # control characters of the same number
        return _UNDEFINED.sub(lambda m: chr(ord(m.group()) - 0xDC00), data.decode(encoding, "surrogateescape"))
    return data.decode(encoding, "replace")


def garble(text: str, chain: tuple[tuple[str, str], ...]) -> str:
    """``text`` as it looks after the chain; characters that a source encoding lacks are dropped."""
    for source, wrong in chain:
        text = _from_bytes(text.encode(source, "ignore"), wrong)
    return text


def _undo(run: str, source: str, wrong: str) -> tuple[str, bool] | None:
    """The run before one step, and whether all of it took part; None if nothing can be undone."""
    if wrong == "utf-8":
        return None
    if source != "utf-8":
        data = _to_bytes(run, wrong)
        try:
            return (data.decode(source), True) if data is not None else None
        except UnicodeDecodeError:
            return None
    out, whole, undone = [], True, 0
    for stretch in _encodable(run, wrong):
        if isinstance(stretch, str):
            out.append(stretch)
            whole = whole and stretch.isascii()
            continue
        at = 0
        for m in _WELL_FORMED.finditer(stretch):
            between = stretch[at : m.start()]
            whole = whole and between.isascii()
            out += [_from_bytes(between, wrong), m.group().decode("utf-8")]
            at, undone = m.end(), undone + len(_from_bytes(m.group(), wrong))
        whole = whole and stretch[at:].isascii()
        out.append(_from_bytes(stretch[at:], wrong))
    return ("".join(out), whole) if undone and undone >= COVERED * sum(c > "\x7f" for c in run) else None


def _encodable(run: str, wrong: str) -> Iterator[bytes | str]:
    """The run's bytes, with characters that the encoding lacks in between."""
    data = _to_bytes(run, wrong)
    if data is not None:
        yield data
        return
    held = bytearray()
    for c in run:
        one = _to_bytes(c, wrong)
        if one is not None:
            held += one
            continue
        if held:
            yield bytes(held)
            held = bytearray()
        yield c
    if held:
        yield bytes(held)


def invert(run: str, chain: tuple[tuple[str, str], ...]) -> tuple[str, bool] | None:
    """The run before the chain, and whether all of it took part; None if it cannot be inverted."""
    whole = True
    for source, wrong in reversed(chain):
        undone = _undo(run, source, wrong)
        if undone is None:
            return None
        run, whole = undone[0], whole and undone[1]
    return run, whole


def _features(text: str) -> np.ndarray:
    """Buckets of the pairs of neighbouring bytes and of bytes two apart, which in two-byte scripts are pairs of letters."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    out = []
    for gap in (1, 2):
        a, b = data[:-gap], data[gap:]
        beyond = (a | b) >= 0x80
        out.append((((a << 8 | b) + np.uint32(gap << 16))[beyond] * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKETS.bit_length() + 1))
    return np.concatenate(out)


@dataclass
class Verdict:
    """On one garbled run: the chain, the run before it (None if lost), whether nothing is lost, and whether the run alone
    is proof. Only chains from UTF-8 leave a form that proves itself; of others a text must have several long runs."""

    chain: str
    restored: str | None
    whole: bool
    alone: bool


@dataclass
class Model:
    """Log odds of each chain against 'clean', and log probabilities of 'clean', by bucket; the characters that clean text
    has (None: any may be)."""

    odds: np.ndarray
    clean: np.ndarray
    attested: frozenset[str] | None

    def _plain(self, text: str) -> float:
        """How likely clean text is, whatever its case: capitals are as clean, but rare."""
        return float(self.clean[_features(text.lower())].sum())

    def _proved(self, text: str, whole: bool) -> bool:
        """Whether an inversion that gives this is no accident: clean text has each of the characters, or others made of the
        same pairs of bytes; or there are too many of them."""
        if self.attested is None or whole and sum(c > "\x7f" for c in text) >= PROOF:
            return True
        floor = float(self.clean.min()) + 0.1
        unknown = {c for c in text if c > "\x7f"} - self.attested - TYPOGRAPHIC
        return all(bool((self.clean[_features(c)] > floor).all()) for c in unknown)

    def judge(self, run: str) -> Verdict | None:
        f = _features(run)
        score = self.odds[:, f].sum(axis=1) + np.log((1 - CLEAN_PRIOR) / CLEAN_PRIOR / len(CHAINS))
        if LOST in run:
            lossy = [at for at, c in enumerate(CHAINS) if c[-1][1] == "utf-8"]
            return Verdict(name(CHAINS[max(lossy, key=lambda at: score[at])]), None, False, True)
        before = self._plain(run)
        for at in np.argsort(-score):
            chain, proof = CHAINS[at], CHAINS[at][0][0] == "utf-8"
            if score[at] < (ENOUGH if proof else ENOUGH_IF_WEAK):
                if score[at] < ENOUGH:
                    break
                continue
            undone = invert(run, chain)
            if undone is not None and self._plain(undone[0]) > before and (not proof or self._proved(*undone)):
                return Verdict(name(chain), *undone, proof)
        return self._in_part(run) if _HAS_WIDE.search(run) else None

    def _in_part(self, run: str) -> Verdict | None:
        """The verdict on a run that as a whole is clean, by its stretches between wide characters."""
        verdicts = {x: v for x in set(_STRETCH.findall(run)) if (v := self.judge(x)) is not None and v.alone}
        if not verdicts:
            return None
        chains = Counter(v.chain for v in verdicts.values())
        restored = _STRETCH.sub(lambda m: verdicts[m.group()].restored if m.group() in verdicts else m.group(), run)
        return Verdict(min(chains, key=lambda c: (-chains[c], c)), restored, all(v.whole for v in verdicts.values()), True)


def _fit(runs: list[str]) -> Model:
    return _model(_class_counts(runs), frozenset("\n".join(runs)))


def _class_counts(runs: list[str]) -> np.ndarray:
    """Bigrams by bucket, of the runs as they are and after each chain."""
    joined = "\n".join(runs)
    return np.stack([_counts(runs), *(_counts(_RUN.findall(garble(joined, c))) for c in CHAINS)])


def _model(counts: np.ndarray, characters: frozenset[str]) -> Model:
    shares = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    logs = np.log((1 - UNSEEN) * shares + UNSEEN / BUCKETS)
    return Model(logs[1:] - logs[0], logs[0], characters)


def _counts(runs: list[str]) -> np.ndarray:
    return np.bincount(_features("\n".join(runs)), minlength=BUCKETS).astype(float)


def in_text(text: str, verdicts: dict[str, Verdict | None]) -> dict[str, Verdict]:
    """The garbled runs of a text, out of the verdicts on its runs."""
    found = {r: v for r in set(_RUN.findall(text)) if (v := verdicts[r]) is not None}
    evidence = Counter()
    for r, v in found.items():
        if not v.alone:
            evidence[_source(v)] += len({c for c in r if c > "\x7f"}) // LONG
    return {r: v for r, v in found.items() if v.alone or evidence[_source(v)] >= LONG_RUNS}


def _source(verdict: Verdict) -> str:
    """What the text was encoded as: pages it may have been taken for agree in most letters, so their evidence adds up."""
    return verdict.chain.partition(">")[0]


def train(texts: list[str], rounds: int = 3) -> Model:
    """The classifier, of sampled texts; runs found garbled by one fit are left out of the next."""
    every = [_RUN.findall(t) for t in texts]
    kept = [r for runs in every for r in runs]
    for n in range(rounds):
        model = _fit(kept)
        if n + 1 < rounds:
            verdicts = {r: model.judge(r) for r in {r for runs in every for r in runs}}
            kept = [r for t, runs in zip(texts, every) for bad in (in_text(t, verdicts),) for r in runs if r not in bad]
    return model


def train_table(sample: DataFrame, text: str = "text", rounds: int = 3) -> Model:
    """The classifier, of a table of sampled texts: ``train`` with the counting done where the texts are. What comes to the
    driver is a number for each class and bucket, and the characters."""
    spark, model = sample.sparkSession, None
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(model)

        def count(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            counts, characters = np.zeros((len(CHAINS) + 1, BUCKETS)), set()
            for b in batches:
                kept: list[str] = []
                for t in b.column(0).to_pylist():
                    runs = _RUN.findall(t)
                    bad = in_text(t, {r: sent.value.judge(r) for r in set(runs)}) if sent.value else {}
                    kept += [r for r in runs if r not in bad]
                counts += _class_counts(kept)
                characters.update(*kept)
            of, at = np.nonzero(counts)
            letters = np.array(sorted(map(ord, characters)), np.int64)
            columns = (np.concatenate([of, np.full(len(letters), -1)]), np.concatenate([at, letters]), np.concatenate([counts[of, at].astype(np.int64), np.ones(len(letters), np.int64)]))
            yield pa.record_batch([pa.array(c.astype(np.int64)) for c in columns], ["of", "at", "n"])

        rows = sample.select(text).mapInArrow(count, "of bigint, at bigint, n bigint").groupBy("of", "at").agg(F.sum("n").alias("n")).toArrow()
        of, at, n = (rows[c].to_numpy() for c in ("of", "at", "n"))
        counts, letter = np.zeros((len(CHAINS) + 1, BUCKETS)), of < 0
        counts[of[~letter], at[~letter]] = n[~letter]
        model = _model(counts, frozenset(map(chr, at[letter].tolist())))
    return model


def wrongly_decoded(records: DataFrame, key: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``<key>, chain, runs, restored, complete`` of every text with a garbled run.

    ``chain`` is that of most garbled runs, ``runs`` their number, ``restored`` the text with the invertible ones restored,
    ``complete`` whether nothing was lost.
    """
    spark = records.sparkSession
    given = records.select(F.col(key), F.col(text)).where(F.col(text).rlike(r"[^\x00-\x7F]"))
    kind = dict(given.dtypes)[key]
    # about sample_rows of all records, by their keys' hashes
    sampled = F.pmod(F.xxhash64(key), F.lit(max(1, records.count() // sample_rows))) == 0
    trained = train_table(materialize(given.where(sampled & (F.length(text) <= SAMPLE_CHARACTERS)).select(text), "encoding-sample"), text)
    first = spark.sparkContext.broadcast(replace(trained, attested=None))

    def invertible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The records with a run that could be inverted; at the end one row of the characters of all others."""
        known: dict[str, bool] = {}
        characters: set[str] = set()
        names = [key, text, "characters"]
        for b in batches:
            kept = []
            for at, t in enumerate(b.column(1).to_pylist()):
                if len(known) > 500_000:
                    known.clear()
                runs = set(_RUN.findall(t))
                for r in runs:
                    if r not in known:
                        known[r] = first.value.judge(r) is not None
                # whatever else a garbled text holds may be garbled beyond inversion
                if any(map(known.__getitem__, runs)):
                    kept.append(at)
                else:
                    characters.update(*runs)
            if kept:
                rows = b.take(pa.array(kept, pa.int64()))
                yield pa.record_batch([*rows.columns, pa.nulls(len(kept), pa.string())], names)
        if characters:
            yield pa.record_batch([pa.nulls(1, b.schema.field(0).type), pa.nulls(1, b.schema.field(1).type), pa.array(["".join(sorted(characters))])], names)

    judged = materialize(given.mapInArrow(invertible, f"`{key}` {kind}, `{text}` string, characters string"), "invertible")
    characters = judged.where(F.col("characters").isNotNull()).select(F.explode(F.split("characters", "")).alias("c")).distinct()
    model = spark.sparkContext.broadcast(replace(trained, attested=frozenset(r[0] for r in characters.collect())))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Verdict | None] = {}
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for i, t in enumerate(b.column(1).to_pylist()):
                if len(known) > 500_000:
                    known.clear()
                runs = _RUN.findall(t)
                for r in runs:
                    if r not in known:
                        known[r] = model.value.judge(r)
                bad = in_text(t, known)
                if not bad:
                    continue
                hit = [bad[r] for r in runs if r in bad]
                chains = Counter(v.chain for v in hit)
                fix = lambda m: v.restored if (v := bad.get(m.group())) and v.restored is not None else m.group()
                for column, value in zip(out, (i, min(chains, key=lambda c: (-chains[c], c)), len(hit), _RUN.sub(fix, t), all(v.whole for v in hit))):
                    column.append(value)
            yield pa.record_batch([b.column(0).take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.string()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.string()), pa.array(out[4], pa.bool_())], [key, "chain", "runs", "restored", "complete"])

    return judged.where(F.col("characters").isNull()).select(key, text).mapInArrow(judge, f"`{key}` {kind}, chain string, runs int, restored string, complete boolean")
