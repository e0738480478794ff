"""webquarry: a Spark-native engine that turns tables of crawled pages into structured evidence about sites."""
