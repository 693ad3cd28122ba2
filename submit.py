"""spark-submit entry point: ``spark-submit --py-files recordloom.zip submit.py <command> ...``."""

from recordloom.cli import main

if __name__ == "__main__":
    main()
