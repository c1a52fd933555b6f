"""Audio features of media columns: polyphase resampling, overlapped log-mel filterbanks, hysteresis energy segments.

A media value is kept as a WAV file of unsigned 8-bit mono samples in a binary column. Features are fixed-shape Arrow tensors
(frames x mel bands, 16-bit floats), one for each time span of a fixed number of frames, the last padded with the floor value. They
are stored in Arrow files in the shared folder, with the span's times and the segments that end in it; features are read from
these files.

A null or empty input becomes one unit of silence bytes (64 zeros). Files of any length are worked on span by span, so memory
doesn't follow their length. Equal samples give equal features: each span is computed by itself, in a fixed order. Repeated
rows are worked on one by one; tables may be empty; other columns pass through untouched.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from hourloom.llm import store

UNIT = 64
HEADER = 44


def wav_bytes(samples: bytes, rate: int) -> bytes:
    """A WAV file of 8-bit mono samples: the 44 bytes of the public RIFF/WAVE PCM header, then the samples."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", HEADER - 8 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples))
    return head + samples


def wav_samples(wav: bytes) -> tuple[int, bytes]:
    """(rate, samples) of such a file."""
    riff, _, wave, fmt, _, kind, channels, rate, _, _, bits, data, size = struct.unpack_from("<4sI4s4sIHHIIHH4sI", wav)
    if (riff, wave, fmt, data, kind, channels, bits) != (b"RIFF", b"WAVE", b"fmt ", b"data", 1, 1, 8) or len(wav) != HEADER + size:
        raise ValueError("not an 8-bit mono PCM file")
    return rate, wav[HEADER:]


@dataclass(frozen=True)
class Settings:
    rate: int = 16_000  # of the stored samples
    up: int = 2  # resampling by up / down
    down: int = 3
    taps: int = 16  # filter taps for each phase
    frame: int = 256
    hop: int = 128
    mels: int = 24
    span: int = 64  # frames in a tensor
    floor: float = -10.0
    high: float = 0.25  # log energy above the running level at which a segment starts, and at which it ends
    low: float = 0.05
    least: int = 3  # frames of the shortest segment kept

    @cached_property
    def phases(self) -> np.ndarray:
        """Windowed-sinc low-pass, one row for each of the `up` output phases."""
        n = self.taps * self.up
        t = np.arange(n) - (n - 1) / 2
        cut = min(1 / self.up, 1 / self.down)
        h = np.sinc(t * cut) * cut * np.hamming(n) * self.up
        return h.reshape(self.taps, self.up).T[:, ::-1].copy()

    @cached_property
    def bank(self) -> np.ndarray:
        """Triangular filters, evenly spaced on the mel scale, over the bins of a real FFT."""
        rate = self.rate * self.up / self.down
        bins = np.arange(self.frame // 2 + 1) * rate / self.frame
        mel = lambda f: 2595 * np.log10(1 + f / 700)
        edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), self.mels + 2) / 2595) - 1)
        rise = (bins[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
        fall = (edges[2:] - bins[:, None]) / (edges[2:] - edges[1:-1])
        return np.maximum(0, np.minimum(rise, fall))

    @cached_property
    def window(self) -> np.ndarray:
        return np.hanning(self.frame + 1)[:-1]


def resample(x: np.ndarray, s: Settings, lead: np.ndarray) -> np.ndarray:
    """Output samples of a stretch: output k takes phase (k * down) % up and the taps before input (k * down) // up.

    lead: the taps - 1 inputs before the stretch.
    """
    if not len(x):
        return np.empty(0)
    views = np.lib.stride_tricks.sliding_window_view(np.concatenate((lead, x)), s.taps)
    n = -(-len(x) * s.up // s.down)
    out = np.empty(n)
    for first in range(min(s.up, n)):
        at = np.arange(first, n, s.up) * s.down
        out[first :: s.up] = views[at // s.up] @ s.phases[at[0] % s.up]
    return out


def spans(samples: bytes, s: Settings) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, bool]]:
    """(first frame, frames, span x mels log-mel tensor, log energies, whether it is the last) of each span of frames, in order."""
    per = s.hop * s.span * s.down // s.up  # inputs that a span of frames starts on
    extra = (s.frame - s.hop) * s.down // s.up  # and those that its last frame reaches beyond
    frames_all = max(1, -(-max(1, len(samples) * s.up // s.down - (s.frame - s.hop)) // s.hop))
    for first in range(0, frames_all, s.span):
        n = min(s.span, frames_all - first)
        at = first // s.span * per
        lead = np.full(s.taps - 1, 0.0)
        before = np.frombuffer(samples[max(0, at - s.taps + 1) : at], np.uint8)
        if len(before):
            lead[-len(before) :] = before.astype(np.float64) / 128 - 1
        x = np.frombuffer(samples[at : at + per + extra], np.uint8).astype(np.float64) / 128 - 1
        y = resample(x, s, lead)
        want = s.frame + s.hop * (n - 1)
        y = np.concatenate((y, np.zeros(max(0, want - len(y)))))[:want]
        view = np.lib.stride_tricks.sliding_window_view(y, s.frame)[:: s.hop]
        power = np.abs(np.fft.rfft(view * s.window, axis=1)) ** 2
        out = np.full((s.span, s.mels), s.floor)
        out[:n] = np.maximum(s.floor, np.log(power @ s.bank + 1e-10))
        yield first, n, out, np.log((view**2).mean(1) + 1e-10), first + s.span >= frames_all


class Hysteresis:
    """Segments of energy: open above level + high, closed below level + low; the level follows slowly."""

    def __init__(self, s: Settings):
        self.s, self.level, self.open_at, self.at = s, None, -1, 0

    def feed(self, energies: np.ndarray) -> Iterator[tuple[int, int]]:
        s = self.s
        for e in energies.tolist():
            if self.level is None:
                self.level = e
            if self.open_at < 0 and e > self.level + s.high:
                self.open_at = self.at
            elif self.open_at >= 0 and e < self.level + s.low:
                if self.at - self.open_at >= s.least:
                    yield self.open_at, self.at
                self.open_at = -1
            self.level += 0.05 * (e - self.level)
            self.at += 1

    def close(self) -> Iterator[tuple[int, int]]:
        if self.open_at >= 0 and self.at - self.open_at >= self.s.least:
            yield self.open_at, self.at


def encode(docs: DataFrame, settings: Settings) -> DataFrame:
    """doc_id, n_bytes, media: the UTF-8 bytes of `text` as samples, padded to a positive multiple of UNIT."""
    store.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [t or b"" for t in store.text_bytes(batch)]
            media = [wav_bytes(t.ljust(max(UNIT, -(-len(t) // UNIT) * UNIT), b"\0"), settings.rate) for t in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in raw], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


PIECE = pa.struct([("start", pa.int32()), ("stop", pa.int32())])
#: Of a stored file, in the row of its first span.
MEDIA = pa.struct([("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string())])
#: Spans written at a time.
SPANS = 256
MANIFEST = "path string, clips long, spans long"


def tensor_schema(s: Settings) -> pa.Schema:
    """clip: number of a media value in its file; mel: a tensor of fixed shape; segments: those that end in the span, in frames."""
    mel = pa.fixed_shape_tensor(pa.float16(), [s.span, s.mels])
    return pa.schema([("clip", pa.int64()), ("doc_id", pa.int64()), ("media", MEDIA), ("span_start_s", pa.float64()), ("span_end_s", pa.float64()), ("frames", pa.int32()), ("segments", pa.list_(PIECE)), ("mel", mel)])


def media_facts(n_bytes: int, wav: bytes) -> tuple[bytes, dict]:
    """The samples that a stored file holds, and what is said of it."""
    _, payload = wav_samples(wav)
    return payload, {
        "n_bytes": n_bytes, "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-UNIT:]),
        "media_bytes": len(wav), "media_sha256": hashlib.sha256(wav).hexdigest(),
    }


def write_tensors(media: DataFrame, settings: Settings, path: str) -> DataFrame:
    """Features of media(doc_id, n_bytes, media) as Arrow files under path; the manifest of files.

    A task writes one file, span by span, so neither a long media value nor a task's output is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        s, schema, clips, written = settings, tensor_schema(settings), 0, 0
        hop_s = s.hop * s.down / s.up / s.rate
        rows: list[tuple] = []
        mels: list[np.ndarray] = []

        def flush(writer) -> None:
            nonlocal written
            mel = pa.FixedShapeTensorArray.from_numpy_ndarray(np.stack(mels))
            cols = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=False)]
            writer.write_batch(pa.RecordBatch.from_arrays([*cols, mel], schema=schema))
            written += len(rows)
            rows.clear()
            mels.clear()

        with store.new_file(path, f"tensors-{TaskContext.get().partitionId():06d}") as (uri, out), pa.ipc.new_file(out, schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            for batch in batches:
                for doc_id, n_bytes, wav in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    payload, facts = media_facts(n_bytes, wav)
                    state, total = Hysteresis(s), 0
                    for first, n, mel, energies, last in spans(payload, s):
                        ended = [*state.feed(energies), *(state.close() if last else ())]
                        rows.append((clips, doc_id, None if first else facts, first * hop_s, (first + n) * hop_s, n, [{"start": a, "stop": b} for a, b in ended]))
                        mels.append(mel.astype(np.float16))
                        total += n
                        if len(rows) == SPANS:
                            flush(writer)
                    clips += 1
            if rows:
                flush(writer)
        yield pa.RecordBatch.from_pylist([{"path": uri, "clips": clips, "spans": written}] if clips else [], pa.schema([("path", pa.string()), ("clips", pa.int64()), ("spans", pa.int64())]))

    return store.materialise(media.select("doc_id", "n_bytes", "media").mapInArrow(run, MANIFEST), "tensor-manifest")


def read_tensors(path: str) -> Iterator[pa.RecordBatch]:
    """The batches of a tensor file, one at a time."""
    fs, own = store.filesystem(path)
    with fs.open_input_file(own) as file:
        reader = pa.ipc.open_file(file)
        for k in range(reader.num_record_batches):
            yield reader.get_batch(k)


DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def read_features(manifest: DataFrame) -> DataFrame:
    """What the tensor files say of each media value, one row each.

    feature: frames, segments as start-end frames, and a hash of the tensors at 1/16 of a natural logarithm.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        names = ["doc_id", *[f.name for f in MEDIA], "feature"]
        kinds = [pa.int64(), *[f.type for f in MEDIA], pa.string()]

        def table() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
            got = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)
            rows.clear()
            return got

        def done(state: list) -> None:
            doc_id, facts, frames, segments, mels = state
            named, covered = ",".join(f"{a}-{b}" for a, b in segments), sum(b - a for a, b in segments)
            rows.append((doc_id, *facts.values(), f"frames={frames};segments={len(segments)};covered={covered};at={named};mel={mels.hexdigest()[:32]}"))

        for batch in batches:
            for path in batch.column(0).to_pylist():
                clip, state = -1, []
                for part in read_tensors(path):
                    own = {name: part.column(k) for k, name in enumerate(part.schema.names)}
                    mel = np.rint(own["mel"].to_numpy_ndarray().astype(np.float32) * 16).astype("<i2")
                    for k, (at, doc_id, facts, n, ended) in enumerate(zip(*(own[c].to_pylist() for c in ("clip", "doc_id", "media", "frames", "segments")), strict=True)):
                        if at != clip:
                            if clip >= 0:
                                done(state)
                            clip, state = at, [doc_id, facts, 0, [], hashlib.sha256()]
                        state[2] += n
                        state[3] += [(x["start"], x["stop"]) for x in ended]
                        state[4].update(mel[k].tobytes())
                    if len(rows) >= 1000:
                        yield table()
                if clip >= 0:
                    done(state)
        yield table()

    # A file is one task's work, as its writing was.
    return manifest.select("path").repartition(store.shuffle_width(manifest.sparkSession)).mapInArrow(run, DIGESTS)


def features(docs: DataFrame, settings: Settings | None = None, path: str | None = None) -> DataFrame:
    """Store docs' texts as media, read the media back, store their features as tensors (under path), and give what these hold."""
    s = settings or Settings()
    media = store.materialise(encode(docs, s), "media")
    return read_features(write_tensors(media, s, path or store.new_path(docs.sparkSession, "tensors")))
