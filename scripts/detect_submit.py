"""spark-submit entry point for the outlier job.

    cd /path/to/repo && zip -qr /tmp/surfacewx.zip surfacewx
    spark-submit --py-files /tmp/surfacewx.zip \
        --conf spark.checkpoint.dir=hdfs:///tmp/surfacewx-ckpt \
        --conf spark.executor.extraJavaOptions=-XX:-DontCompileHugeMethods \
        scripts/detect_submit.py ISD_DIR OUT_DIR [LAT LON ELEV RADIUS DELTA] --stations isd-history.csv

Arguments are those of ``python -m surfacewx`` (see ``surfacewx.plans.cli``).
"""

import sys

from surfacewx.plans.cli import main

if __name__ == "__main__":
    sys.exit(main())
