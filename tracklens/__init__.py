"""tracklens: player x item performance analytics as Spark DataFrame operators."""
