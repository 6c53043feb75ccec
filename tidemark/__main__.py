"""``python -m tidemark``."""

from .cli import main

main()
