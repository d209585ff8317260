"""The session stream: frames in, labelled windows out, each once, at a cost that follows the new text.

A session's text is that of its frames in the order of their numbers. A frame drops every
earlier arrival whose number is not smaller. What remains does not
depend on the order in which a batch brings the frames, so batches of any cut and chunks of any
order give one text.

State goes on from the last stable place: the first window that is not settled yet. Each frame
keeps where that was when the frame was added, so a rewind restarts there. Window texts that were
scored stay known by their hash. Every entry of the state expires ``ttl`` after it was written; a rewind past
expired frames restarts at the oldest one left.

Each call into the state store costs far more than a window does, so the entries of windows are blocks: labels that were
sent lie together by the place where the window starts, scored texts in parts by hash that hold some :data:`_PART` each. A
batch reads and writes the blocks that it touches, and these are of bounded size however long the session is.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "session string, start long, stop long, label string"
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
#: Scored texts of a session before its next ones go to a level with more parts, and about what each part holds; parts of a level.
_PART, _FAN = 64, 16
_DIGEST = 16

#: Labels of each text.
Score = Callable[[list[str]], list[list[str]]]


class Survivors:
    """Frames that no later arrival dropped: numbers and arrivals both ascend."""

    def __init__(self, known: list[tuple[int, int]]):
        self.seqs = [s for s, _ in known]
        self.arrivals = [a for _, a in known]

    def add(self, seq: int, arrival: int) -> tuple[bool, list[int]]:
        """Whether the frame stays, and the numbers that it drops. A frame that is there already stays as it is."""
        at = bisect_right(self.seqs, seq)
        if at and (self.arrivals[at - 1] > arrival or (self.seqs[at - 1], self.arrivals[at - 1]) == (seq, arrival)):
            return False, []
        first = bisect_left(self.seqs, seq)
        last = max(first, bisect_left(self.arrivals, arrival))
        dropped = self.seqs[first:last]
        self.seqs[first:last], self.arrivals[first:last] = [seq], [arrival]
        return True, dropped


def _level(scored: int) -> int:
    """The level that takes the next text of a session with so many: each has ``_FAN`` times the parts of the one before."""
    level, room = 0, _PART
    while scored >= room:
        level += 1
        room += _PART * _FAN**level
    return level


def _part(level: int, digest: bytes) -> tuple[int, int]:
    return level, int.from_bytes(digest[:7], "big") % _FAN**level


class SessionWindows(StatefulProcessor):
    """STM-01/02/06: windows of ``size`` tokens every ``stride``; a window is settled when a stride of tokens more has come, or the session was flushed."""

    def __init__(self, score: Score, size: int, stride: int, ttl: int):
        self.score, self.size, self.stride, self.ttl = score, size, stride, ttl * 1000
        self.span = 256 * stride  # code points of a block of sent labels: a few dozen windows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.index = handle.getMapState("index", "seq int", "arrival long, begin long, k long, at long", self.ttl)
        self.texts = handle.getMapState("texts", "seq int", "text string", self.ttl)
        self.end = handle.getValueState("end", "seq int, arrival long, stop long, k long, at long, tail string, flushed boolean, scored long", self.ttl)
        self.sent = handle.getMapState("sent", "block long", "start array<long>, stop array<long>, label array<string>, at array<long>", self.ttl)
        self.memo = handle.getMapState("memo", "level int, part long", "segments binary, labels array<array<string>>", self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, last_arrival, stop, k, at, tail, flushed, scored = self.end.get() or (-(2**31), -(2**63), 0, 0, 0, "", False, 0)
        held: Survivors | None = None  # of the frames of batches before, read only where one of them may be touched
        fresh = Survivors([])  # frames after all of those
        touched: list[int] = []
        added: dict[int, str] = {}
        for chunk in rows:
            for seq, arrival, text, flush in zip(*(chunk[c] for c in ("seq", "arrival", "text", "flush")), strict=True):
                seq, arrival, flushed = int(seq), int(arrival), bool(flushed or flush)
                if held is None and seq <= last:
                    held = Survivors(sorted((s, a) for (s,), (a, *_) in self.index.iterator()))
                    for s, a in zip(fresh.seqs, fresh.arrivals, strict=True):
                        held.add(s, a)
                frames = fresh if held is None else held
                if held is None and arrival < last_arrival:
                    continue  # the last frame arrived later and has a smaller number
                stays, dropped = frames.add(seq, arrival)
                if stays:
                    added[seq] = "" if text is None else text
                    self.texts.updateValue((seq,), (added[seq],))
                    touched += [seq, *dropped]
                    for s in dropped:
                        if s != seq:
                            added.pop(s, None)
                            self.texts.removeKey((s,))
        rows_out: list[tuple[int, int, str]] = []
        if touched or flushed:
            first = min(touched, default=last + 1)
            if held is None:
                order = fresh.seqs
            else:
                order = held.seqs[bisect_left(held.seqs, first) :]
                if first <= last:
                    stop, k, at, tail = self._rewound(first, held.seqs)
            found, end = self._settled(order, added, stop, k, at, tail, flushed, held or fresh, (last, last_arrival))
            rows_out, scored = self._unsent(found, scored, timerValues.getCurrentProcessingTimeInMs())
            self.end.update((*end, scored))
        yield pd.DataFrame([(key[0], *x) for x in rows_out], columns=["session", "start", "stop", "label"])

    def _rewound(self, first: int, kept: list[int]) -> tuple[int, int, int, str]:
        """The state before the first frame from number ``first`` on; frames that are gone leave the index."""
        later = sorted(s for (s,) in self.index.keys() if s >= first)
        _, begin, k, at = self.index.getValue((later[0],))
        alive = set(kept)
        for s in later:
            if s not in alive:
                self.index.removeKey((s,))
        parts, reach = [], begin
        for s in reversed(kept[: bisect_left(kept, first)]):
            if reach <= at:
                break
            text = self.texts.getValue((s,))
            if text is None:  # expired: go on from what is left
                break
            parts.append(text[0])
            reach -= len(text[0])
        at = max(at, reach)
        return begin, k, at, "".join(reversed(parts))[at - reach :]

    def _settled(self, order: list[int], added: dict[int, str], stop: int, k: int, at: int, tail: str, flushed: bool, frames: Survivors, end: tuple[int, int]) -> tuple[list[tuple[int, int, str]], tuple]:
        """Add the frames in ``order``, of which this batch ``added`` some, to the text; returns the windows that are settled now (start, stop and text) and the end."""
        found = []
        tokens = [(at + m.start(), at + m.end()) for m in _TOKEN.finditer(tail)]
        arrivals = dict(zip(frames.seqs, frames.arrivals, strict=True))
        for seq in order:
            self.index.updateValue((seq,), (arrivals[seq], stop, k, at))
            text = added[seq] if seq in added else self.texts.getValue((seq,))[0]
            # the last token may go on in this frame
            since = tokens.pop()[0] if tokens and tokens[-1][1] == stop else stop
            tail += text
            stop += len(text)
            tokens += [(since + m.start(), since + m.end()) for m in _TOKEN.finditer(tail[since - at :])]
            skip = 0
            while len(tokens) - skip >= self.size + self.stride:
                a, b = tokens[skip][0], tokens[skip + self.size - 1][1]
                found.append((a, b, tail[a - at : b - at]))
                skip += self.stride
                k += 1
            if skip:
                tokens = tokens[skip:]
                tail, at = tail[tokens[0][0] - at :], tokens[0][0]
        if order:
            end = (frames.seqs[-1], frames.arrivals[-1])
        now = (*end, stop, k, at, tail, flushed)
        if flushed and tokens:
            whole = max((len(tokens) - self.size) // self.stride + 1, 1 if k == 0 else 0)
            for j in range(whole):
                own = tokens[j * self.stride : j * self.stride + self.size]
                found.append((own[0][0], own[-1][1], tail[own[0][0] - at : own[-1][1] - at]))
        return found, now

    def _labels(self, texts: dict[bytes, str], scored: int) -> tuple[dict[bytes, list[str]], int]:
        """Labels of texts by their digests, scored where the session does not know them, and how many it has scored then."""
        parts: dict[tuple[int, int], dict[bytes, list[str]]] = {}
        labels: dict[bytes, list[str]] = {}
        for level in range(_level(scored - 1) + 1 if scored else 0):
            for digest in texts:
                if digest in labels:
                    continue
                part = _part(level, digest)
                if part not in parts:
                    segments, known = self.memo.getValue(part) or (b"", [])
                    parts[part] = {bytes(segments[_DIGEST * i : _DIGEST * (i + 1)]): list(x) for i, x in enumerate(known)}
                if digest in parts[part]:
                    labels[digest] = parts[part][digest]
        missing = [digest for digest in texts if digest not in labels]
        grown = set()
        for digest, own in zip(missing, self.score([texts[x] for x in missing]) if missing else [], strict=True):
            part = _part(_level(scored), digest)  # read above, or of a level that is still empty
            labels[digest] = parts.setdefault(part, {})[digest] = sorted(set(own))
            grown.add(part)
            scored += 1
        for part in grown:
            self.memo.updateValue(part, (b"".join(parts[part]), [*parts[part].values()]))
        return labels, scored

    def _unsent(self, found: list[tuple[int, int, str]], scored: int, now: int) -> tuple[list[tuple[int, int, str]], int]:
        """Labels of windows, scored once for each text, without what was sent before; and how many texts are scored then."""
        digests = [hashlib.blake2b(text.encode(), digest_size=_DIGEST).digest() for *_, text in found]
        labels, scored = self._labels({digest: text for digest, (*_, text) in zip(digests, found, strict=True)}, scored)
        blocks: dict[int, dict[tuple[int, int, str], int]] = {}
        grown, out = set(), []
        for digest, (a, b, _) in zip(digests, found, strict=True):
            for label in labels[digest]:
                block = a // self.span
                if block not in blocks:
                    known = zip(*(self.sent.getValue((block,)) or ((),) * 4), strict=True)
                    blocks[block] = {(start, stop, name): at for start, stop, name, at in known if at + self.ttl > now}
                if (a, b, label) not in blocks[block]:
                    blocks[block][a, b, label] = now
                    grown.add(block)
                    out.append((a, b, label))
        for block in grown:
            self.sent.updateValue((block,), tuple(map(list, zip(*((*x, at) for x, at in blocks[block].items()), strict=True))))
        return out, scored

    def close(self) -> None:
        pass


def session_windows(frames: DataFrame, score: Score, size: int = 512, stride: int = 256, ttl: int = 3600) -> DataFrame:
    """``frames(session, seq, arrival, text, flush)`` as a stream, to ``(session, start, stop, label)``, code points of the session's text.

    Arrivals order a session's frames; a frame that comes again with its number and arrival changes nothing.
    A null text is empty; a null flush is false. ``ttl`` is in seconds. The session must use the RocksDB state store.
    """
    from pyspark.sql import functions as F

    rows = frames.select("session", "seq", "arrival", "text", F.coalesce("flush", F.lit(False)).alias("flush"))
    return rows.groupBy("session").transformWithStateInPandas(SessionWindows(score, size, stride, ttl), OUTPUT, "Append", "ProcessingTime")


def term_labels(terms: tuple[str, ...]) -> Score:
    """A score that labels a text with the terms in it."""
    return lambda texts: [[t for t in terms if t in text] for text in texts]


class SessionSpans(StatefulProcessor):
    """Every place of a term in a session's text, sent once; the text is searched anew when it has changed, so this is for short sessions."""

    def __init__(self, terms: tuple[str, ...]):
        self.terms = terms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.frames = handle.getMapState("frames", "seq int", "arrival long, text string")
        self.sent = handle.getMapState("sent", "start int, end int, word string", "yes boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        texts = {s: (a, text) for (s,), (a, text) in self.frames.iterator()}
        held = Survivors(sorted((s, a) for s, (a, _) in texts.items()))
        for pdf in rows:
            for seq, arrival, text in pdf[["seq", "arrival", "text"]].itertuples(index=False):
                stays, dropped = held.add(int(seq), int(arrival))
                for s in dropped:
                    texts.pop(s, None)
                    self.frames.removeKey((s,))
                if stays:
                    texts[int(seq)] = (int(arrival), text or "")
                    self.frames.updateValue((int(seq),), texts[int(seq)])
        whole = "".join(text for _, (_, text) in sorted(texts.items()))
        found = []
        for term in self.terms:
            at = whole.find(term)
            while at >= 0:
                span = (at, at + len(term), term)
                if not self.sent.containsKey(span):
                    self.sent.updateValue(span, (True,))
                    found.append((key[0], *span))
                at = whole.find(term, at + len(term))
        yield pd.DataFrame(found, columns=["session", "start", "end", "word"])

    def close(self) -> None:
        pass


def session_spans(frames: DataFrame, terms: tuple[str, ...]) -> DataFrame:
    """``frames(session, seq, arrival, text)`` as a stream, to ``(session, start, end, word)``: places of terms, also across frames."""
    return frames.groupBy("session").transformWithStateInPandas(SessionSpans(terms), "session string, start int, end int, word string", "Append", "None")
