from .lines import ByteLinesSource, ReaderSource
from .plain import ChainSource, ChannelSource, FnSource, IterSource, TableSource

__all__ = ["ByteLinesSource", "ChainSource", "ChannelSource", "FnSource", "IterSource", "ReaderSource", "TableSource"]
