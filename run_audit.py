"""Launcher for spark-submit (a package's __main__ cannot be submitted directly):

    zip -r cohortlens.zip cohortlens
    spark-submit --py-files cohortlens.zip run_audit.py --events ... --out ... [--cube]
"""

from cohortlens.__main__ import main

if __name__ == "__main__":
    main()
