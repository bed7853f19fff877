"""Reading and writing of diaries, results and reports."""
