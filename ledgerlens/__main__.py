from ledgerlens.cli import main

main()
