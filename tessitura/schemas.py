"""Columns, keys and enumerations of the entities, as fixed values."""

DOCUMENT_REQUIRED = ("id", "tipo", "titulo", "fonte", "url_original", "formato_original", "texto", "metodo_extracao", "extrator", "scraped_at")
DOCUMENT_KEY = ("id", "metodo_extracao")
CHUNK_REQUIRED = (
    "chunk_id", "document_id", "metodo_extracao", "extrator", "chunk_strategy", "chunk_level", "chunk_index", "texto",
    "citation_label", "tipo", "titulo", "fonte", "formato_original", "url_original",
)
METADATA_COLUMNS = (
    "chunk_id", "document_id", "parent_chunk_id", "chunk_strategy", "chunk_level", "chunk_index", "metodo_extracao", "extrator", "texto", "secao", "artigo", "paragrafo", "inciso", "alinea",
    "citation_label", "tipo", "subtipo", "numero", "ano", "titulo", "assunto", "situacao", "fonte", "formato_original", "url_original", "url_consolidado", "qualidade_extracao",
)
METHODS = ("texto", "markdown")
STRATEGIES = ("fixed-size", "article-aware", "hierarchical", "hierarchical-child")
IN_FORCE = ("vigente", "consolidada")
EXCLUDED_STATUS = ("revogada",)
QUERY_TYPES = ("factual", "procedural", "definition", "comparison")
DIFFICULTIES = ("easy", "medium", "hard")
ANSWERABILITIES = ("corpus_supported", "source_only", "not_in_corpus")

MIN_TEXT = 100
STORE_KEYS = ("provider", "model", "chunk_strategy", "metodo_extracao")
CORPUS_PARTITIONS = ("tipo", "metodo_extracao")
CHUNK_PARTITIONS = ("chunk_strategy", "metodo_extracao", "tipo")
