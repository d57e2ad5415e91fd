"""Where datasets come from."""

from shardflow.sources.files import binary_listing, numbered_words, text_dir, text_file, text_of_listing, text_of_paths, xml_rows
from shardflow.sources.memory import GeneratorSource, channel, generate, slice_of

__all__ = ["GeneratorSource", "binary_listing", "channel", "generate", "numbered_words", "slice_of", "text_dir", "text_file", "text_of_listing", "text_of_paths", "xml_rows"]
