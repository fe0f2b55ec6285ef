"""DataFrame -> DataFrame operators over ``customer_transactions``."""
