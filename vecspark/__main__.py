from vecspark.cli import main

main()
