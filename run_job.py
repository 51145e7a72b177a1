"""Launcher for spark-submit: ``spark-submit --py-files cubewright.zip run_job.py <build|report|analog> ...``"""

from cubewright.plans.run import main

if __name__ == "__main__":
    main()
