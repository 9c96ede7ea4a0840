"""gravitas: profiling, preparation, modelling and scoring of severity-labelled tables on Spark."""
