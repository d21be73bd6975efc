"""Sources and sinks: JSON-lines papers, driver tables, edge/partition files."""

from semweave.sources.tables import (
    load_table, papers_from_documents, vectors_from_embeddings, node_table,
    label_partition, quality_partition, duplicate_edges,
)
from semweave.sources.papers import PAPER_SCHEMA, read_papers, clean_papers, papers_as_json_lines
from semweave.sources.files import (
    write_table, read_edges, write_edges, read_partition, write_partition,
    read_embeddings, write_embeddings, write_one_row_json, require_columns,
    paper_metadata, write_best_config, load_best_partition,
)

__all__ = [
    "load_table", "papers_from_documents", "vectors_from_embeddings", "node_table",
    "label_partition", "quality_partition", "duplicate_edges",
    "PAPER_SCHEMA", "read_papers", "clean_papers", "papers_as_json_lines",
    "write_table", "read_edges", "write_edges", "read_partition", "write_partition",
    "read_embeddings", "write_embeddings", "write_one_row_json", "require_columns",
    "paper_metadata", "write_best_config", "load_best_partition",
]
