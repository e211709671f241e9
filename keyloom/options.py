"""Options of tables."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Options:
    block_size: int = 4096
    restart_interval: int = 16
    bits_per_key: int = 10
    #: A tag in each block's trailer; what compresses is the storage format.
    compression_tag: int = 1
    cache_capacity: int = 10
    cache_shards: int = 4


#: Bytes of a block's trailer (type, masked checksum) and of the footer, and the footer's magic number.
TRAILER, FOOTER, MAGIC = 5, 40, 0x04452B9527C24933
#: Fixed value: the name under which tables store their filter.
FILTER_NAME = "general_bloomfilter"
