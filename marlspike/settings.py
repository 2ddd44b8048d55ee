"""Engine settings: a frozen dataclass with the defaults of every bound and size."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # Default sizes, bounds and names.
    chunk_size: int = 1000
    chunk_overlap: int = 200
    separators: tuple[str, ...] = ("\n\n", "\n", " ", "")
    max_upload_bytes: int = 10 * 1024 * 1024
    max_name_length: int = 255
    max_qubits: int = 10
    shots: int = 1024
    boost: float = 2.0
    max_iterations: int = 10
    default_top_k: int = 5
    default_threshold: float = 0.7
    chat_threshold: float = 0.3
    collection: str = "pdf_documents"
    embedding_model: str = "sentence-transformers/all-MiniLM-L6-v2"

    @property
    def max_boosted(self) -> int:
        """The most candidates that a boosted search takes."""
        return 2**self.max_qubits


DEFAULTS = Settings()
