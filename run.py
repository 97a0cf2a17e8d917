"""``spark-submit run.py <command> ...``; the commands are listed in ``hearsay.jobs``."""

from hearsay.jobs import main

if __name__ == "__main__":
    main()
