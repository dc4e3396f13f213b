"""``spark-submit run_job.py counts|max ...``; see ``telewin.app``."""

import sys

from telewin.app import main

if __name__ == "__main__":
    main(sys.argv[1:])
