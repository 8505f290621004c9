"""covaria.operators"""
