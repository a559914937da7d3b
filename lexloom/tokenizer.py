"""The tokenizer as one object: train, save counts, encode, decode, export."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.bytetext import parse_size
from lexloom.functions.pretok import Spec, resolve_spec
from lexloom.functions.specials import SpecialTokens
from lexloom.memory import MemoryMonitor
from lexloom.operators import chunks, encode, export, merges
from lexloom.session import discard, materialize, ship
from lexloom.sources.text import from_iterable


class Tokenizer:
    """Byte-level merges with special tokens.

    Ids: bytes 0 to 255, merges from 256 in training order, specials behind them. ``vocab_size``
    doesn't count specials. Training replaces whatever the object held before.
    """

    def __init__(self, spark: SparkSession | None = None):
        self.spark = spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
        ship(self.spark)
        self.merges: list[merges.Merge] = []
        self.spec: Spec = resolve_spec()
        self.specials = SpecialTokens()
        self.peak_rss_bytes = 0
        self.on_round: Callable[[int, int], None] | None = None  # told how many merges of how many there are

    def _monitor(self, wanted: bool, warn_at: str | int | None) -> MemoryMonitor | None:
        if not wanted and warn_at is None:
            return None
        limit = parse_size(warn_at) if isinstance(warn_at, str) else warn_at
        if isinstance(warn_at, str) and limit is None:
            raise ValueError(f"can't read size {warn_at!r}")
        return MemoryMonitor(limit).start()

    def _end(self, monitor: MemoryMonitor | None) -> None:
        if monitor:
            self.peak_rss_bytes = max(self.peak_rss_bytes, monitor.stop())

    def train_from_dataframe(self, df: DataFrame, text: str, vocab_size: int, min_frequency: int = 1, pattern: str | None = None, pre_tokenizer: str | None = None, special_tokens: Iterable[str] | None = None, merge_mode: str | None = None, monitor_ram: bool = False, ram_warn_at: str | int | None = None) -> None:
        """Train on a column of any DataFrame; nothing but the chunk counts leaves the executors."""
        spec, specials = resolve_spec(pre_tokenizer, pattern), SpecialTokens(special_tokens or ())
        merges.parse_mode(merge_mode)
        monitor = self._monitor(monitor_ram, ram_warn_at)
        try:
            counts = chunks.chunk_counts(df, text, spec.build, specials)
            self.merges = merges.train(counts, vocab_size, min_frequency, merge_mode, self.on_round)
        finally:
            self._end(monitor)
        self.spec, self.specials = spec, specials

    def train_from_iterator(self, iterator: Iterable[str], vocab_size: int, buffer_size: int = 8192, pattern: str | None = None, min_frequency: int = 1, pre_tokenizer: str | None = None, special_tokens: Iterable[str] | None = None, merge_mode: str | None = None, monitor_ram: bool = False, ram_warn_at: str | int | None = None) -> None:
        resolve_spec(pre_tokenizer, pattern)
        self.train_from_dataframe(from_iterable(self.spark, iterator, buffer_size), "text", vocab_size, min_frequency, pattern, pre_tokenizer, special_tokens, merge_mode, monitor_ram, ram_warn_at)

    def aggregate_dataframe(self, df: DataFrame, text: str, output_path: str, pattern: str | None = None, pre_tokenizer: str | None = None, special_tokens: Iterable[str] | None = None) -> dict:
        """Count chunks and write them with what they are; returns the statistics."""
        spec, specials = resolve_spec(pre_tokenizer, pattern), SpecialTokens(special_tokens or ())
        counts = materialize(chunks.chunk_counts(df, text, spec.build, specials))
        bytes_ = df.where(F.col(text).isNotNull()).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("b")).first()
        total = counts.agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("c"), F.count("*").alias("u")).first()
        stats = {"total_sequences": bytes_["n"], "total_bytes": bytes_["b"], "total_chunks": total["c"], "unique_chunks": total["u"]}
        chunks.write_artifact(counts, output_path, spec.canonical, spec.pattern, specials, stats)
        discard(counts)
        return stats

    def aggregate(self, iterator: Iterable[str], output_path: str, buffer_size: int = 8192, pattern: str | None = None, pre_tokenizer: str | None = None, special_tokens: Iterable[str] | None = None, monitor_ram: bool = False, ram_warn_at: str | int | None = None) -> dict:
        monitor = self._monitor(monitor_ram, ram_warn_at)
        try:
            return self.aggregate_dataframe(from_iterable(self.spark, iterator, buffer_size), "text", output_path, pattern, pre_tokenizer, special_tokens)
        finally:
            self._end(monitor)

    def train_from_aggregate(self, agg_path: str, vocab_size: int, min_frequency: int = 1, merge_mode: str | None = None, monitor_ram: bool = False, ram_warn_at: str | int | None = None) -> None:
        """Train on written counts; the pipeline and the specials are those of the counts."""
        counts, meta = chunks.read_artifact(self.spark, agg_path)
        monitor = self._monitor(monitor_ram, ram_warn_at)
        try:
            self.merges = merges.train(counts, vocab_size, min_frequency, merge_mode, self.on_round)
        finally:
            self._end(monitor)
        self.spec, self.specials = resolve_spec(meta["pre_tokenizer_config"]), SpecialTokens(meta["special_tokens"] or ())

    @property
    def vocab_size(self) -> int:
        return 256 + len(self.merges)

    def get_pattern(self) -> str:
        return self.spec.pattern

    def get_mergeable_ranks(self) -> list[tuple[bytes, int]]:
        return export.ranks(self.merges)

    def add_special_tokens(self, tokens: Iterable[str]) -> None:
        for t in tokens:
            self.specials.add(t)

    def get_special_tokens(self) -> list[str]:
        return list(self.specials.tokens)

    def truncated(self, vocab_size: int) -> Tokenizer:
        """The tokenizer that training to a smaller vocabulary gives: the merges are a prefix."""
        out = Tokenizer(self.spark)
        out.merges, out.spec, out.specials = self.merges[: max(0, vocab_size - 256)], self.spec, self.specials
        return out

    def encode_dataframe(self, df: DataFrame, key: str, text: str) -> DataFrame:
        return encode.encode(df, key, text, self.merges, self.spec.build, self.specials)

    def decode_dataframe(self, df: DataFrame, key: str, ids: str, with_specials: bool = False) -> DataFrame:
        return encode.decode(df, key, ids, self.merges, self.specials if with_specials else None)

    def batch_encode(self, texts: Iterable[str]) -> list[list[int]]:
        rows = self.encode_dataframe(from_iterable(self.spark, texts), "seq", "text").collect()
        return [r["ids"] for r in sorted(rows, key=lambda r: r["seq"])]

    def encode(self, text: str) -> list[int]:
        return self.batch_encode([text])[0]

    def decode(self, ids: Iterable[int], with_specials: bool = False) -> str:
        """Special ids are unknown here unless asked for; unknown ids raise ValueError."""
        names = merges.token_bytes(self.merges) + ([t.encode() for t in self.specials.tokens] if with_specials else [])
        return encode.decode_ids(list(ids), names)

    def save_huggingface(self, output_dir: str, special_tokens: Iterable[str] | None = None, write_config: bool = True, always_split_digits: bool = False) -> None:
        specials = self.specials if special_tokens is None else SpecialTokens(special_tokens)
        export.write_huggingface(output_dir, self.merges, self.spec.pattern, specials, self.spec.splits_digits or always_split_digits, write_config)

    def save_tiktoken(self, output_dir: str) -> None:
        export.write_tiktoken(output_dir, self.merges, self.spec.pattern, self.specials)
