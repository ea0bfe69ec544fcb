"""Configuration of the retrieval engine: one frozen record, stored as JSON.

checkpoint is the hash encoder or a local folder with a tokenizer and a model.
Settings about devices are kept for the record's sake; Spark places the work.
"""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass


#: The checkpoint that needs no files.
HASH_ENCODER = "hash-encoder"


@dataclass(frozen=True)
class RetrievalConfig:
    # Run
    use_gpu: bool = False
    rank: int = 0
    nranks: int = 1
    # Tokens
    query_token_id: str = "[unused0]"
    doc_token_id: str = "[unused1]"
    query_token: str = "[Q]"
    doc_token: str = "[D]"
    # Sources
    checkpoint: str = HASH_ENCODER
    collection: str = ""
    # Documents and queries
    dim: int = 128
    doc_maxlen: int = 300
    mask_punctuation: bool = True
    query_maxlen: int = 32
    attend_to_mask_tokens: bool = False
    # Index
    index_path: str = ""
    index_bsize: int = 64
    chunksize: int | None = 25000
    passages_batch_size: int = 5000
    nbits: int = 2
    kmeans_niters: int = 20
    # Search
    nprobe: int = 2
    ncandidates: int = 8192

    def __post_init__(self) -> None:
        if self.rank:
            raise ValueError("rank must be 0: Spark deals the work out itself")

    def to_json(self) -> str:
        return json.dumps(dataclasses.asdict(self), indent=1, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> RetrievalConfig:
        found = json.loads(text)
        unknown = set(found) - {f.name for f in dataclasses.fields(cls)}
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return cls(**found)
