"""covaria.streaming"""
